class LodestoneError(Exception):
    """Base of this library's errors."""


class InvalidRequest(LodestoneError):
    pass


class RegexCompileError(LodestoneError):
    pass


class GlobError(LodestoneError):
    pass


class CorruptIndex(LodestoneError):
    pass


class RebuildAlreadyRunning(LodestoneError):
    pass


class SearchTimeout(LodestoneError):
    def __init__(self, request_id: str | None, timeout_ms: int) -> None:
        super().__init__(f"request {request_id} took more than {timeout_ms} ms")
        self.request_id, self.timeout_ms = request_id, timeout_ms
