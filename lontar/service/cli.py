"""A command-line client of the service: statements from a file or typed in, each ended by -:"""

from __future__ import annotations

import argparse
import getpass
import json
import sys
import urllib.error
import urllib.request
from typing import Any

from lontar.dialect.lexer import split_statements
from lontar.engine.formatter import QueryResult, table


class Client:
    def __init__(self, url: str, user: str, password: str):
        self.url, self.token = url.rstrip("/"), None
        self.token = self._call("POST", "/session", {"user": user, "password": password})["token"]

    def _call(self, method: str, path: str, body: dict[str, Any] | None = None) -> dict[str, Any]:
        headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {self.token}"} if self.token else {})
        request = urllib.request.Request(self.url + path, json.dumps(body).encode() if body is not None else None, headers, method=method)
        try:
            with urllib.request.urlopen(request) as response:
                return json.load(response)
        except urllib.error.HTTPError as e:
            raise RuntimeError(json.load(e).get("error", str(e))) from None

    def query(self, text: str) -> QueryResult:
        got = self._call("POST", "/query", {"query": text})
        plain = lambda v: v["value"] if isinstance(v, dict) else v
        return QueryResult(got["columns"], [[plain(v) for v in row] for row in got["rows"]])

    def close(self) -> None:
        self._call("DELETE", "/session")


def run(client: Client, lines, out=sys.stdout, stop: bool = False) -> int:
    """Send statements as they are completed; the number of errors."""
    rest, bad = "", 0
    for line in lines:
        if line.strip().startswith(".") and not rest.strip():
            parts = [line.strip()]
        else:
            parts, rest = split_statements(rest + line)
        for part in parts:
            try:
                print(table(client.query(part)), file=out)
            except RuntimeError as e:
                print(f"Error: {e}", file=out)
                bad += 1
                if stop:
                    return bad
    return bad


def main() -> None:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("--url", default="http://127.0.0.1:8080")
    p.add_argument("--user", default="admin")
    p.add_argument("--file")
    a = p.parse_args()
    client = Client(a.url, a.user, getpass.getpass())
    try:
        with open(a.file, encoding="utf-8") if a.file else sys.stdin as lines:
            sys.exit(run(client, lines, stop=bool(a.file)) > 0)
    finally:
        client.close()


if __name__ == "__main__":
    main()
