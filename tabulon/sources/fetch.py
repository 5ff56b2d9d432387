"""Optional fetcher for the public archive: files over HTTP into a landing folder.

It isn't part of any query. One process fetches, at most REQUESTS_PER_SECOND, since the archive
limits each client as a whole.
"""

from __future__ import annotations

import os
import time
import urllib.error
import urllib.request
from collections.abc import Callable

from tabulon import schemas as S


class StatusError(IOError):
    """An answer other than 2xx."""

    def __init__(self, status: int, url: str):
        super().__init__(f"GET {url}: status {status}")
        self.status, self.url = status, url


def _open(url: str, agent: str) -> tuple[int, bytes]:
    try:
        with urllib.request.urlopen(urllib.request.Request(url, headers={"User-Agent": agent}), timeout=S.TIMEOUT_S) as r:
            return r.status, r.read()
    except urllib.error.HTTPError as e:
        return e.code, b""


class Fetcher:
    """GET with a contact in the User-Agent, a rate cap, and one retry of a 5xx answer.

    ``transport`` takes (url, agent) and returns (status, body); tests give their own.
    """

    def __init__(self, agent: str | None = None, transport: Callable[[str, str], tuple[int, bytes]] = _open, sleep: Callable[[float], None] = time.sleep, clock: Callable[[], float] = time.monotonic):
        self.agent = agent or os.environ.get("TABULON_USER_AGENT", "")
        if not self.agent:
            raise ValueError("set TABULON_USER_AGENT to a contact: the archive asks for one")
        self.transport, self.sleep, self.clock, self.next = transport, sleep, clock, 0.0

    def _once(self, url: str) -> bytes:
        now = self.clock()
        if now < self.next:
            self.sleep(self.next - now)
        self.next = max(now, self.next) + 1 / S.REQUESTS_PER_SECOND
        status, body = self.transport(url, self.agent)
        if not 200 <= status < 300:
            raise StatusError(status, url)
        return body

    def get(self, url: str) -> bytes:
        try:
            return self._once(url)
        except StatusError as e:
            if not 500 <= e.status <= 599:
                raise
        self.sleep(S.RETRY_S)
        return self._once(url)


def submissions_url(cik: int) -> str:
    return f"{S.DATA}/submissions/CIK{cik:010d}.json"


def tickers_url() -> str:
    return f"{S.ARCHIVE}/files/company_tickers.json"
