"""A small HTTP service over sessions: JSON in, JSON out, bearer tokens, roles and budgets.

GET /health; POST /session {user, password} -> {token}; POST /query {query}; DELETE /session.
It is meant for the driver's machine; put a proxy before it for anything public.
"""

from __future__ import annotations

import hmac
import json
import secrets
import threading
import time
from collections.abc import Mapping
from dataclasses import dataclass, field
from hashlib import pbkdf2_hmac
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from typing import Any

from pyspark.sql import SparkSession

from lontar import errors
from lontar.engine.formatter import to_json
from lontar.engine.session import Session

HTTP = {errors.SYNTAX: 400, errors.GENERAL: 400, errors.TYPE: 400, errors.CONSTRAINT: 409, errors.CONFLICT: 409, errors.STORAGE: 500, errors.UNKNOWN: 500}
MOST_BODY = 1 << 20


@dataclass(frozen=True)
class Limits:
    """seconds: of one query. rows: of one result. idle, absolute: seconds that a token lasts. tries, lockout: failed logins, and seconds."""

    seconds: float = 30.0
    rows: int = 100_000
    idle: float = 1800.0
    absolute: float = 43_200.0
    tries: int = 5
    lockout: float = 300.0


def hash_password(password: str, salt: bytes | None = None) -> str:
    salt = salt or secrets.token_bytes(16)
    return f"{salt.hex()}:{pbkdf2_hmac('sha256', password.encode(), salt, 200_000).hex()}"


def check_password(password: str, stored: str) -> bool:
    return hmac.compare_digest(hash_password(password, bytes.fromhex(stored.split(":")[0])), stored)


@dataclass
class Login:
    session: Session
    made: float
    used: float
    lock: threading.Lock = field(default_factory=threading.Lock)


class Service:
    """users: name -> (password hash, role)."""

    def __init__(self, spark: SparkSession, root: str, users: Mapping[str, tuple[str, str]], limits: Limits = Limits()):
        self.spark, self.root, self.users, self.limits = spark, root, dict(users), limits
        self.logins: dict[str, Login] = {}
        self.failed: dict[str, tuple[int, float]] = {}
        self.lock = threading.Lock()

    def open(self, user: str, password: str) -> tuple[int, dict[str, Any]]:
        now = time.monotonic()
        count, since = self.failed.get(user, (0, now))
        if count >= self.limits.tries and now - since < self.limits.lockout:
            return 429, {"error": "locked"}
        if user not in self.users or not check_password(password, self.users[user][0]):
            with self.lock:
                self.failed[user] = (count + 1 if now - since < self.limits.lockout else 1, now)
            return 401, {"error": "login failed"}
        token = secrets.token_urlsafe(32)
        with self.lock:
            self.failed.pop(user, None)
            self.logins[token] = Login(Session(self.spark, self.root, self.users[user][1], self.limits.rows), now, now)
        return 200, {"token": token}

    def login(self, token: str | None) -> Login | None:
        now = time.monotonic()
        with self.lock:
            found = self.logins.get(token or "")
            if found and (now - found.used > self.limits.idle or now - found.made > self.limits.absolute):
                del self.logins[token]
                return None
            if found:
                found.used = now
            return found

    def close(self, token: str | None) -> bool:
        with self.lock:
            return self.logins.pop(token or "", None) is not None

    def query(self, login: Login, text: str) -> tuple[int, str]:
        """Run one statement or monitor command within the budget of time; its jobs are cancelled when that is over."""
        tag, late = f"query-{secrets.token_hex(8)}", threading.Event()

        def stop() -> None:
            late.set()
            self.spark.sparkContext.cancelJobsWithTag(tag)

        with login.lock:  # one query of a session at a time
            timer = threading.Timer(self.limits.seconds, stop)
            self.spark.sparkContext.addJobTag(tag)
            timer.start()
            try:
                s = login.session
                return 200, to_json(s.monitor(text) if text.lstrip().startswith(".") else s.execute(text))
            except errors.EngineError as e:
                return HTTP.get(e.category, 400), json.dumps({"error": e.message, "category": e.category}, ensure_ascii=False)
            except Exception as e:  # Spark's own errors reach the client as text
                if late.is_set():
                    return 408, json.dumps({"error": f"stopped after {self.limits.seconds:g} s", "category": errors.GENERAL})
                return 400, json.dumps({"error": str(e).split("\n")[0][:300], "category": errors.GENERAL}, ensure_ascii=False)
            finally:
                timer.cancel()
                self.spark.sparkContext.removeJobTag(tag)


def serve(service: Service, host: str = "127.0.0.1", port: int = 0) -> ThreadingHTTPServer:
    """Start serving in a thread; `server_address` has the port, `shutdown` ends it."""

    class Handler(BaseHTTPRequestHandler):
        def _send(self, status: int, body: str) -> None:
            raw = body.encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json; charset=utf-8")
            self.send_header("Content-Length", str(len(raw)))
            self.end_headers()
            self.wfile.write(raw)

        def _token(self) -> str | None:
            kind, _, token = self.headers.get("Authorization", "").partition(" ")
            return token if kind == "Bearer" else None

        def _body(self) -> dict[str, Any] | None:
            size = int(self.headers.get("Content-Length") or 0)
            if size > MOST_BODY:
                self._send(413, '{"error": "too large"}')
                return None
            try:
                body = json.loads(self.rfile.read(size))
            except ValueError:
                body = None
            if not isinstance(body, dict):
                self._send(400, '{"error": "not a JSON object"}')
                return None
            return body

        def do_GET(self) -> None:  # noqa: N802
            self._send(*((200, '{"status": "ok"}') if self.path == "/health" else (404, '{"error": "not found"}')))

        def do_POST(self) -> None:  # noqa: N802
            body = self._body()
            if body is None:
                return
            if self.path == "/session":
                status, out = service.open(str(body.get("user", "")), str(body.get("password", "")))
                self._send(status, json.dumps(out))
            elif self.path == "/query":
                login = service.login(self._token())
                self._send(*(service.query(login, str(body.get("query", ""))) if login else (401, '{"error": "no session"}')))
            else:
                self._send(404, '{"error": "not found"}')

        def do_DELETE(self) -> None:  # noqa: N802
            ok = self.path == "/session" and service.close(self._token())
            self._send(200 if ok else 401, json.dumps({"closed": ok}))

        def log_message(self, *_: Any) -> None:
            pass

    server = ThreadingHTTPServer((host, port), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    return server
