"""The tools over standard input and output: JSON-RPC 2.0 messages, one a line, as the Model Context Protocol has them.

A tool's answer is a text of JSON; a tool that fails answers with `isError` and a reason, and the server goes on.
"""

from __future__ import annotations

import json
import os
import sys
import time
from typing import TextIO

from pyspark.sql import functions as F

from marlstone.api import Engine, is_under

PROTOCOL = "2024-11-05"
TEXT, WHOLE = {"type": "string"}, {"type": "integer"}


def _tool(name: str, about: str, required: tuple[str, ...] = (), **properties: dict) -> dict:
    return {"name": name, "description": about, "inputSchema": {"type": "object", "properties": properties, **({"required": list(required)} if required else {})}}


TOOLS = [
    _tool("search_documents", "Finds passages by meaning and by words; filters by file type, author and document type.", ("query",), query=TEXT, n_results={**WHOLE, "default": 10}, file_type=TEXT, author=TEXT, doc_type=TEXT),
    _tool("get_document", "A document's text, a page of chunks at a time.", ("file_path",), file_path=TEXT, chunk_offset={**WHOLE, "default": 0}, chunk_limit={**WHOLE, "default": 50}),
    _tool("list_documents", "The documents that the filters let through.", file_type=TEXT, author=TEXT, doc_type=TEXT, limit={**WHOLE, "default": 20}),
    _tool("reindex", "Indexes new and changed documents and drops deleted ones."),
    _tool("get_stats", "How many documents there are, and how far indexing is."),
]


class Refused(Exception):
    """Why a call cannot be answered, in words for the caller."""


class Server:
    def __init__(self, engine: Engine):
        self.engine = engine

    def call(self, name: str, arguments: dict | None) -> dict:
        """The envelope of a tool's answer."""
        tool = getattr(self, f"_{name}", None) if name in {t["name"] for t in TOOLS} else None
        try:
            if tool is None:
                raise Refused(f"unknown tool: {name}")
            return {"content": [{"type": "text", "text": _dump(tool(arguments or {}))}], "isError": False}
        except Refused as e:
            why = str(e)
        except Exception as e:  # the reason goes to the log, not to the caller
            print(f"{name} failed: {type(e).__name__}: {e}", file=sys.stderr)
            why = f"{name} failed"
        return {"content": [{"type": "text", "text": _dump({"error": why})}], "isError": True}

    def _search_documents(self, a: dict) -> dict:
        query = a.get("query")
        if not query:
            raise Refused("query is required")
        n = max(1, min(int(a.get("n_results", 10)), 100))
        filters = {k: a.get(k) for k in ("file_type", "author", "doc_type")}
        hits = self.engine.search_documents(query, n, **filters)
        own = [c for c in self.engine.indexer.store.schema.names if c not in ("text", "embedding")]
        rows = hits.join(self.engine.indexer.store.read().select(*own), "chunk_id").orderBy("rank").select("chunk_id", "preview", "score", F.to_json(F.struct(*[c for c in own if c != "chunk_id"])).alias("metadata")).collect()
        return {"query": query, "n_results": len(rows), "results": [{"chunk_id": r["chunk_id"], "text": r["preview"], "score": r["score"], "source_collection": "documents", "metadata": json.loads(r["metadata"])} for r in rows]}

    def _get_document(self, a: dict) -> dict:
        path = a.get("file_path")
        if not path:
            raise Refused("file_path is required")
        path = os.path.expanduser(path)
        if not is_under(path, self.engine.indexer.root):
            raise Refused("the path is not allowed")
        if not os.path.isfile(path):
            raise Refused(f"no such file: {path}")
        offset, limit = max(0, int(a.get("chunk_offset", 0))), max(1, min(int(a.get("chunk_limit", 50)), 50))
        page = self.engine.get_document(path, offset, limit).first()
        if not page["total_chunks"]:
            raise Refused(f"no text in {path}")
        return {"file_path": path, "file_name": os.path.basename(path), "total_chunks": page["total_chunks"], "total_characters": page["total_chars"], "returned_chunks": max(0, min(limit, page["total_chunks"] - offset)), "chunk_offset": offset, "chunk_limit": limit, "has_more": page["has_more"], "next_offset": page["next_offset"], "text": page["content"]}

    def _list_documents(self, a: dict) -> dict:
        filters = {k: a.get(k) for k in ("file_type", "author", "doc_type")}
        limit = max(1, min(int(a.get("limit", 20)), 100))
        rows = [r.asDict() for r in self.engine.list_documents(**filters, limit=limit).collect()]
        shown = ("file_path", "file_name", "file_type", "doc_title", "doc_author", "doc_type")
        return {"total_matched": rows[0]["total_matched"] if rows else 0, "filters": {**filters, "limit": limit}, "documents": [{k: r[k] for k in shown} for r in rows]}

    def _reindex(self, a: dict) -> dict:
        began = time.time()
        found = self.engine.indexer.pending()
        done = self.engine.reindex().first()
        out = {"status": "done", "detected": {f"{k}_files": found.get(k, 0) for k in ("new", "changed", "deleted")}, "results": {"success": done["success"], "fail": done["failed"], "deleted": found.get("deleted", 0), "total_chunks_added": done["chunks"]}, "elapsed_seconds": round(time.time() - began, 1)}
        return out | ({"bm25_rebuilt": True} if self.engine.mode == "hybrid" else {})

    def _get_stats(self, a: dict) -> dict:
        s = self.engine.get_stats().first().asDict()
        return {"mode": "local", "vectordb": {"documents": s["documents"]}, "indexing": {k: s[k] for k in ("total", "indexed", "failed", "pending")}}

    def answer(self, message: dict) -> dict | None:
        """The reply to a message; none to a notification."""
        if "id" not in message:
            return None
        method, params = message.get("method"), message.get("params") or {}
        if method == "initialize":
            result = {"protocolVersion": params.get("protocolVersion", PROTOCOL), "capabilities": {"tools": {}}, "serverInfo": {"name": "marlstone", "version": "1"}}
        elif method == "tools/list":
            result = {"tools": TOOLS}
        elif method == "tools/call":
            result = self.call(params.get("name", ""), params.get("arguments"))
        elif method == "ping":
            result = {}
        else:
            return {"jsonrpc": "2.0", "id": message["id"], "error": {"code": -32601, "message": f"no such method: {method}"}}
        return {"jsonrpc": "2.0", "id": message["id"], "result": result}

    def run(self, source: TextIO, sink: TextIO) -> None:
        """Answers the source's messages until it ends."""
        for line in source:
            if not line.strip():
                continue
            try:
                message = json.loads(line)
                reply = self.answer(message) if isinstance(message, dict) else None
            except ValueError:
                reply = {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": "not JSON"}}
            if reply is not None:
                sink.write(json.dumps(reply, ensure_ascii=False) + "\n")
                sink.flush()


def _dump(value: dict) -> str:
    return json.dumps(value, ensure_ascii=False, indent=2)
