"""python -m lodestone.server: a JSON-RPC server on standard input and output, one message a line, with
the one tool get_context(task, root)."""

from __future__ import annotations

import json
import sys

TOOL = {
    "name": "get_context",
    "description": "Select the files of a repository worth reading for a task, with reasons, excerpts and findings.",
    "inputSchema": {"type": "object", "properties": {"task": {"type": "string"}, "root": {"type": "string", "default": "."}}, "required": ["task"]},
}


class Server:
    def __init__(self, run, version: str = "0.1.0"):
        self.run, self.version = run, version

    def answer(self, message: dict) -> dict | None:
        """The reply to one message; None for notifications."""
        if "id" not in message:
            return None
        reply = {"jsonrpc": "2.0", "id": message["id"]}
        try:
            return reply | {"result": self._result(message.get("method"), message.get("params") or {})}
        except LookupError as error:
            return reply | {"error": {"code": -32601, "message": str(error.args[0])}}

    def _result(self, method: str, params: dict) -> dict:
        if method == "initialize":
            return {"protocolVersion": params.get("protocolVersion", "2024-11-05"), "capabilities": {"tools": {}}, "serverInfo": {"name": "lodestone", "version": self.version}}
        if method == "ping":
            return {}
        if method == "tools/list":
            return {"tools": [TOOL]}
        if method != "tools/call" or params.get("name") != TOOL["name"]:
            raise LookupError(f"unknown: {params.get('name') or method}")
        given = params.get("arguments") or {}
        try:
            text, failed = json.dumps(self.run(given.get("task", ""), given.get("root", ".")), ensure_ascii=False), False
        except (ValueError, OSError) as error:
            text, failed = f"{type(error).__name__}: {error}", True
        return {"content": [{"type": "text", "text": text}], "isError": failed}

    def serve(self, lines, out) -> None:
        for line in lines:
            if not line.strip():
                continue
            try:
                reply = self.answer(json.loads(line))
            except ValueError:
                reply = {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": "no JSON"}}
            if reply is not None:
                out.write(json.dumps(reply, ensure_ascii=False) + "\n")
                out.flush()


def main() -> None:
    from pyspark.sql import SparkSession

    from .plans.context import get_context

    out, sys.stdout = sys.stdout, sys.stderr  # nothing else may write between messages
    builder = SparkSession.builder.appName("lodestone").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.shuffle.partitions", "8")
    Server(lambda task, root: get_context(builder.getOrCreate(), task, root)).serve(sys.stdin, out)


if __name__ == "__main__":
    main()
