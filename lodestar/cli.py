"""``python -m lodestar.cli FOLDER QUESTION``: an answer from a folder, as JSON; ``--serve PORT`` answers over HTTP instead."""

from __future__ import annotations

import argparse
import json
import logging
import sys
from http.server import BaseHTTPRequestHandler, HTTPServer

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.questions import valid
from .plans.planner import STRATEGIES, answer
from .session import session
from .sources.files import read_folder


class JsonLines(logging.Formatter):
    """One JSON object a record."""

    def format(self, r):
        said = {"time": self.formatTime(r), "message": r.getMessage(), "logger": r.name, "level": r.levelname}
        return json.dumps(said)


def configure_logging(level: str = "INFO", as_json: bool = True) -> None:
    handler = logging.StreamHandler()
    if as_json:
        handler.setFormatter(JsonLines())
    logging.basicConfig(level=level, handlers=[handler], force=True)


def ask(docs: DataFrame, question: str, limit: int = 5, strategy: str = "hybrid") -> dict:
    """One question's answer as plain data; ValueError for a question that is not valid."""
    spark = docs.sparkSession
    asked = spark.createDataFrame([(0, valid(question))], "query_id int, query string")
    return answer(docs, asked, limit, strategy).drop("query_id").first().asDict(recursive=True)


def documents(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """Documents of a request: id, text, source and title, of which all but the text may be missing."""
    if not rows or not all(isinstance(r, dict) and isinstance(r.get("text"), str) for r in rows):
        raise ValueError("documents must be objects with a text")
    listed = [(str(r.get("id") or i), r["text"], str(r.get("source") or ""), str(r.get("title") or "")) for i, r in enumerate(rows)]
    return spark.createDataFrame(listed, "doc_id string, text string, source string, title string")


def handler(spark: SparkSession) -> type[BaseHTTPRequestHandler]:
    class Handler(BaseHTTPRequestHandler):
        def reply(self, code: int, body: dict) -> None:
            raw = json.dumps(body, default=str).encode()
            self.send_response(code)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(raw)))
            self.end_headers()
            self.wfile.write(raw)

        def do_GET(self) -> None:
            known = {"/health": {"status": "ok"}, "/config": {"strategies": sorted(STRATEGIES)}}
            self.reply(*((200, known[self.path]) if self.path in known else (404, {"error": "no such path"})))

        def do_POST(self) -> None:
            try:
                body = json.loads(self.rfile.read(int(self.headers.get("Content-Length") or 0)) or b"{}")
                if self.path == "/query":
                    docs = documents(spark, body.get("documents"))
                elif self.path == "/query-folder":
                    docs = read_folder(spark, body.get("docs_dir") or "")
                else:
                    return self.reply(404, {"error": "no such path"})
                self.reply(200, ask(docs, body.get("question"), int(body.get("limit", 5)), body.get("strategy", "hybrid")))
            except (ValueError, KeyError, NotADirectoryError) as e:
                self.reply(400, {"error": str(e)})
            except Exception:
                logging.exception("a request failed")
                self.reply(500, {"error": "the request failed"})

        def log_message(self, pattern: str, *args) -> None:
            logging.info(pattern, *args)

    return Handler


def main(args=None) -> int:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("folder", nargs="?")
    parser.add_argument("question", nargs="?")
    parser.add_argument("--limit", type=int, default=5)
    parser.add_argument("--serve", type=int)
    found = parser.parse_args(args)
    configure_logging("WARNING")
    spark = session("lodestar-cli", "local[*]")
    if found.serve:
        HTTPServer(("127.0.0.1", found.serve), handler(spark)).serve_forever()
    if not found.folder or not found.question:
        parser.error("a folder and a question are needed")
    print(json.dumps(ask(read_folder(spark, found.folder).select("doc_id", "text", "source", "title"), found.question, found.limit), default=str))
    return 0


if __name__ == "__main__":
    sys.exit(main())
