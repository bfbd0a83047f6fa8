"""The labelling service: JSON payloads of folders, images, manifest checks and commits, and a small
HTTP shell around them.

Payloads are computed by the library's own operators; a folder's listing is what goes over the wire, so
it is collected.  Files are moved by the file system's rename; only moved records are rewritten.
"""

from __future__ import annotations

import gzip
import json
from http.server import BaseHTTPRequestHandler
from urllib.parse import parse_qs, urlsplit

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from plumbline.functions import text
from plumbline.operators import manifest as M
from plumbline.sources import files, records, sinks

#: Responses of so many bytes are compressed where the client takes it.
GZIP_BYTES = 4096


class NotFound(ValueError):
    """What was asked for is not there, or lies outside the root."""


class Service:
    """Payloads over one session; ``root`` and ``manifest`` are the defaults of a request."""

    def __init__(self, spark: SparkSession, root: str = "", manifest: str = "") -> None:
        self.spark, self.root, self.manifest = spark, root, manifest

    def defaults(self) -> dict:
        return {"root": self.root, "manifest": self.manifest}

    def _folder(self, root: str, *parts: str) -> str:
        """A path below the root, normalised; what escapes or does not exist raises."""
        cols = [F.lit(p) for p in parts]
        path = text.normalized(text.joined(F.lit(root), *cols))
        found, ok = self.spark.range(1).select(path, text.within(path, F.lit(root))).first()
        if not ok or not sinks.exists(self.spark, found):
            raise NotFound("/".join(parts) or root)
        return found

    def _entries(self, path: str) -> list[tuple[str, bool]]:
        """(name, is a folder) in a folder, by name in either case."""
        p, fs = sinks._fs(self.spark, path)
        if not fs.getFileStatus(p).isDirectory():
            raise NotFound(path)
        return sorted(((x.getPath().getName(), x.isDirectory()) for x in fs.listStatus(p)), key=lambda x: x[0].lower())

    def _names(self, path: str) -> list[str]:
        return [n for n, is_dir in self._entries(path) if not is_dir and n.lower().endswith(files.REVIEW_EXTENSIONS)]

    def listdir(self, path: str) -> dict:
        path = self._folder(path)
        dirs = [{"name": n, "images": len(self._names(f"{path}/{n}"))} for n, is_dir in self._entries(path) if is_dir]
        return {"path": path, "parent": path.rpartition("/")[0] or ("/" if path != "/" else None), "dirs": dirs}

    def folders(self, root: str) -> dict:
        listed = self.listdir(root)
        return {"root": listed["path"], "folders": [{"name": d["name"], "count": d["images"]} for d in listed["dirs"]]}

    def _index(self, manifest: str):
        if not manifest or not sinks.exists(self.spark, manifest):
            return self.spark.createDataFrame([], records.CROP)
        return records.read_manifest(self.spark, manifest)

    def _images(self, folder: str, names: list[str]):
        return self.spark.createDataFrame([(folder, n) for n in names], "folder string, filename string")

    def check(self, root: str, manifest: str = "", sub: str = "") -> dict:
        """Whether a root and a manifest belong together: the pairing status of a folder."""
        root = self._folder(root)
        names = self._names(self._folder(root, sub)) if sub else []
        there = bool(manifest) and sinks.exists(self.spark, manifest)
        one = self.spark.createDataFrame([(sub, root, manifest or None, manifest.rpartition("/")[0], there)], "folder string, root string, manifest_path string, manifest_dir string, exists boolean")
        row = M.pairing_status(one, self._images(sub, names), self._index(manifest)).first()
        return {"root": root, "manifest": {"path": manifest or None, "exists": there, "status": row["status"], "matched": row["matched"], "checked": row["checked"]}}

    def images(self, root: str, sub: str, manifest: str = "") -> dict:
        """The images of a folder with ten fields of their records."""
        state = self.check(root, manifest, sub)["manifest"]
        names = self._names(self._folder(root, sub))
        shown = {r["file"]: r["meta"].asDict() for r in M.image_meta(self._images(sub, names), self._index(manifest)).collect()}
        return {"sub": sub, "images": [{"file": n, "meta": shown[n]} for n in names], "manifest": state, "manifest_found": state["exists"], "root_manifest_mismatch": state["status"] in ("outside", "no_match")}

    def image(self, root: str, sub: str, file: str) -> tuple[str, bytes]:
        """(type, bytes) of one image."""
        path = self._folder(root, sub, file)
        if not path.lower().endswith(files.REVIEW_EXTENSIONS):
            raise ValueError("not an image")
        kind, data = self.spark.read.format("binaryFile").load(path).select(text.data_url(F.col("path"), F.lit(b"")), "content").first()
        return kind[5:].split(";")[0], bytes(data)

    def commit(self, payload: dict) -> dict:
        """Apply queued moves in order, then set ``manual_root`` in the records of what moved.

        The plan of the moves decides; a rename that fails in spite of it is reported as skipped and
        leaves its record as it was."""
        root, manifest = self._folder(payload["root"]), payload.get("manifest") or ""
        moves = [(i, m.get("file"), m.get("from"), m.get("to")) for i, m in enumerate(payload.get("moves", []))]
        queued = self.spark.createDataFrame(moves, "ord long, file string, `from` string, `to` string")
        here = files.scan(self.spark, root, files.REVIEW_EXTENSIONS)
        below = F.substring(F.regexp_replace(F.regexp_replace("path", "^[a-z]+:/*", "/"), "/[^/]*$", ""), len(root) + 2, 1 << 20)
        plan = M.commit_moves(queued, here.select(F.col("name").alias("file"), below.alias("folder")), root).orderBy("ord").collect()
        moved, skipped = [], []
        for r in plan:
            reason = r["reason"] or self._move(root, r["file"], r["from"], r["to"])
            (skipped if reason else moved).append({"file": r["file"], **({"reason": reason} if reason else {"from": r["from"], "to": r["to"]})})
        out = {"moved": moved, "skipped": skipped, "manifest_updated": 0, "manifest_no_record": [], "manifest_path": manifest or None, "manifest_written": False}
        if moved and manifest and sinks.exists(self.spark, manifest):
            report = self.spark.createDataFrame([(i, m["file"], m["to"], True) for i, m in enumerate(moved)], "ord long, file string, to string, moved boolean")
            lines = M.patch_manifest(records.read_lines(self.spark, manifest), report)
            out["manifest_no_record"] = sorted(r["file"] for r in M.moved_without_record(report, self._index(manifest)).collect())
            out["manifest_updated"] = len({m["file"] for m in moved}) - len(out["manifest_no_record"])
            sinks.rewrite_lines(lines, manifest)
            out["manifest_written"] = True
        return out

    def _move(self, root: str, file: str, src: str, dst: str) -> str | None:
        a, fs = sinks._fs(self.spark, f"{root}/{src}/{file}")
        b, _ = sinks._fs(self.spark, f"{root}/{dst}/{file}")
        try:
            fs.mkdirs(b.getParent())
            return None if fs.rename(a, b) else "rename failed"
        except Exception as e:
            return str(e).splitlines()[0]


def handler(service: Service) -> type[BaseHTTPRequestHandler]:
    """A request handler over ``service``, for an ``http.server``."""

    class Handler(BaseHTTPRequestHandler):
        protocol_version = "HTTP/1.1"

        def log_message(self, *args) -> None:
            pass

        def _send(self, body: bytes, kind: str, status: int = 200) -> None:
            squeeze = kind.startswith("application/json") and len(body) >= GZIP_BYTES and "gzip" in self.headers.get("Accept-Encoding", "")
            body = gzip.compress(body, 5) if squeeze else body
            self.send_response(status)
            for name, value in (("Content-Type", kind), ("Content-Length", str(len(body))), *([("Content-Encoding", "gzip")] if squeeze else [])):
                self.send_header(name, value)
            self.end_headers()
            self.wfile.write(body)

        def _answer(self, make) -> None:
            try:
                found, status = make(), 200
            except NotFound as e:
                found, status = {"error": f"not found: {e}"}, 404
            except Exception as e:
                found, status = {"error": f"{type(e).__name__}: {e}"}, 500
            if isinstance(found, tuple):
                self._send(found[1], found[0])
            else:
                self._send(json.dumps(found).encode(), "application/json; charset=utf-8", status)

        def do_GET(self) -> None:
            url = urlsplit(self.path)
            q = {k: v[0] for k, v in parse_qs(url.query).items()}
            root, manifest, sub = q.get("root", service.root), q.get("manifest", ""), q.get("sub", "")
            routes = {
                "/api/defaults": service.defaults, "/api/listdir": lambda: service.listdir(q.get("path") or service.root), "/api/folders": lambda: service.folders(root),
                "/api/check": lambda: service.check(root, manifest, sub), "/api/images": lambda: service.images(root, sub, manifest), "/img": lambda: service.image(root, sub, q.get("file", "")),
            }

            def missing():
                raise NotFound(url.path)

            self._answer(routes.get(url.path, missing))

        def do_POST(self) -> None:
            body = self.rfile.read(int(self.headers.get("Content-Length", 0))) or b"{}"

            def commit():
                if urlsplit(self.path).path != "/api/commit":
                    raise NotFound(self.path)
                return service.commit(json.loads(body))

            self._answer(commit)

    return Handler
