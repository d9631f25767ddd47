"""The engine's methods over JSON-RPC with Content-Length frames on two streams."""

from __future__ import annotations

import argparse
import json
import os
import sys
from collections.abc import Callable
from typing import IO, Any

from ..errors import InvalidRequest, LodestoneError
from .engine import Engine
from .search import HashSearchOptions, SearchOptions

_LISTS = ("include", "exclude", "globs")
_FLAGS = ("case_sensitive", "dotall", "multiline", "no_snippet", "literal", "parallel")
_STRINGS = {"type": "array", "items": {"type": "string"}}
_COMMON = {"include": _STRINGS, "exclude": _STRINGS, "globs": _STRINGS, "max_results": {"type": "integer"}, "case_sensitive": {"type": "boolean"}, "no_snippet": {"type": "boolean"}, "return_mode": {"enum": ["matches", "ids", "paths", "count"]}, "timeout_ms": {"type": "integer"}, "request_id": {"type": "string"}}
_PATTERN = {"pattern": {"type": "string"}, **_COMMON, "dotall": {"type": "boolean"}, "multiline": {"type": "boolean"}, "literal": {"type": "boolean"}, "parallel": {"type": "boolean"}, "options": {"type": "object"}}


def search_options(args: dict[str, Any]) -> SearchOptions:
    """An `options` object takes the place of all options beside it."""
    given = args["options"] if isinstance(args.get("options"), dict) else args
    return SearchOptions(**_common(given, (*_FLAGS,)))


def hash_options(args: dict[str, Any]) -> HashSearchOptions:
    return HashSearchOptions(**_common(args, ("case_sensitive", "no_snippet")), verify_literal=args.get("verify_literal"))


def _common(given: dict[str, Any], flags: tuple[str, ...]) -> dict[str, Any]:
    out: dict[str, Any] = {}
    for k in _LISTS:
        if k in given:
            if not isinstance(given[k], list) or not all(isinstance(x, str) for x in given[k]):
                raise InvalidRequest(f"{k} must be a list of strings")
            out[k] = tuple(given[k])
    for k in flags:
        if isinstance(given.get(k), bool):
            out[k] = given[k]
    for k in ("max_results", "timeout_ms"):
        if isinstance(given.get(k), int) and given[k] >= 0:
            out[k] = given[k]
    for k in ("return_mode", "request_id"):
        if isinstance(given.get(k), str):
            out[k] = given[k]
    return out


def _wanted(args: dict, key: str, kind: type, tool: str) -> Any:
    if not isinstance(args.get(key), kind):
        raise InvalidRequest(f"{tool} requires {key!r}")
    return args[key]


def _hashes(args: dict) -> list[int]:
    found = _wanted(args, "hashes", list, "hash_search")
    if not all(isinstance(h, int) and not isinstance(h, bool) and 0 <= h < 1 << 64 for h in found):
        raise InvalidRequest("hashes must be unsigned 64-bit numbers")
    return found


def _paths(args: dict) -> list[str]:
    found = _wanted(args, "changed_files", list, "index_update_files")
    if not all(isinstance(p, str) for p in found):
        raise InvalidRequest("changed_files must be strings")
    return found


TOOLS: dict[str, tuple[Callable[[Engine, dict], dict], str, dict, list[str]]] = {
    "regex_search": (lambda e, a: e.regex_search(_wanted(a, "pattern", str, "regex_search"), search_options(a)), "Search by regular expression.", _PATTERN, ["pattern"]),
    "hot_search": (lambda e, a: e.hot_search(_wanted(a, "pattern", str, "hot_search"), search_options(a)), "Search documents of recent results.", _PATTERN, ["pattern"]),
    "hash_search": (lambda e, a: e.hash_search(_hashes(a), a.get("logic", "and"), hash_options(a)), "Search by gram hashes.", {"hashes": {"type": "array", "items": {"type": "integer"}}, "logic": {"enum": ["and", "or"]}, "verify_literal": {"type": "string"}, **_COMMON}, ["hashes"]),
    "literal_search": (lambda e, a: e.literal_search(_wanted(a, "pattern", str, "literal_search"), search_options(a)), "Search for a string.", _PATTERN, ["pattern"]),
    "index_status": (lambda e, a: e.index_status(), "State of the index.", {}, []),
    "index_update_files": (lambda e, a: e.index_update_files(_paths(a)), "Put changed files into the overlay.", {"changed_files": _STRINGS}, ["changed_files"]),
    "index_rebuild": (lambda e, a: e.index_rebuild(a.get("mode", "background")), "Build the index again.", {"mode": {"enum": ["foreground", "background"]}}, []),
}


def manifest() -> list[dict]:
    return [{"name": n, "description": d, "inputSchema": {"type": "object", "properties": p, "required": r}} for n, (_, d, p, r) in TOOLS.items()]


def call(engine: Engine, name: str, args: dict) -> dict:
    if name not in TOOLS:
        raise InvalidRequest(f"unknown tool {name!r}")
    return TOOLS[name][0](engine, args)


def handle(engine: Engine, message: Any) -> dict | None:
    """The reply to a message; None to a notification, of which only a rebuild does anything."""
    if not isinstance(message, dict) or not isinstance(message.get("method"), str):
        return _error(None, -32700, "not a request")
    method, params = message["method"], message.get("params")
    params = params if isinstance(params, dict) else {}
    if "id" not in message:
        if method == "index_rebuild":
            call(engine, method, params)
        return None
    try:
        if method == "initialize":
            result: Any = {"protocolVersion": "2024-11-05", "capabilities": {"tools": {}}, "serverInfo": {"name": "lodestone", "version": "1"}}
        elif method == "tools/list":
            result = {"tools": manifest()}
        elif method == "tools/call":
            found = call(engine, _wanted(params, "name", str, method), params["arguments"] if isinstance(params.get("arguments"), dict) else {})
            result = {"content": [{"type": "text", "text": json.dumps(found)}], "structuredContent": found, "isError": False}
        else:
            result = call(engine, method, params)
    except (LodestoneError, KeyError, TypeError, ValueError) as e:
        return _error(message["id"], -32000, str(e))
    return {"jsonrpc": "2.0", "id": message["id"], "result": result}


def _error(id_: Any, code: int, text: str) -> dict:
    return {"jsonrpc": "2.0", "id": id_, "error": {"code": code, "message": text}}


def read_message(stream: IO[bytes]) -> Any:
    """None at the end of the stream; broken framing raises."""
    length = None
    while True:
        line = stream.readline()
        if not line:
            return None
        if line in (b"\r\n", b"\n"):
            break
        name, _, value = line.decode("ascii", "replace").partition(":")
        if name.strip().lower() == "content-length":
            length = int(value)
    if length is None:
        raise ValueError("a frame has no Content-Length")
    try:
        return json.loads(stream.read(length))
    except json.JSONDecodeError:
        return object()


def write_message(stream: IO[bytes], message: dict) -> None:
    body = json.dumps(message, default=str).encode()
    stream.write(b"Content-Length: %d\r\n\r\n" % len(body) + body)
    stream.flush()


def serve(engine: Engine, source: IO[bytes], sink: IO[bytes]) -> None:
    while (message := read_message(source)) is not None:
        if (reply := handle(engine, message)) is not None:
            write_message(sink, reply)


def arguments(argv: list[str], env: dict[str, str]) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="lodestone")
    parser.add_argument("--workspace", default=os.getcwd())
    parser.add_argument("--index-root")
    parser.add_argument("--auto-index", dest="auto_index", action="store_true", default=True)
    parser.add_argument("--no-auto-index", dest="auto_index", action="store_false")
    out = parser.parse_args(argv)
    said = env.get("LODESTONE_AUTO_INDEX", "").strip().lower()
    out.auto_index = said in ("1", "true", "yes") or (said not in ("0", "false", "no") and out.auto_index)
    return out


def main() -> None:
    from pyspark.sql import SparkSession

    args = arguments(sys.argv[1:], dict(os.environ))
    spark = SparkSession.builder.appName("lodestone").getOrCreate()
    serve(Engine.over_files(spark, args.workspace, args.index_root, args.auto_index), sys.stdin.buffer, sys.stdout.buffer)


if __name__ == "__main__":
    main()
