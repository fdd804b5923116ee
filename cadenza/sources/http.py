"""Paged REST source and lookup providers. The transport is given by the caller, so everything works without a network.

These run on the driver, one request at a time: the services limit rates, and tasks would multiply them.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from typing import Any, Protocol

from ..functions.text import redact

# What the services mean by "try again".
TRANSIENT_STATUS = frozenset({429, 500, 502, 503, 504})
TRANSIENT_CODE = "8"


class Response(Protocol):
    status_code: int
    text: str

    def json(self) -> Any: ...


Transport = Callable[[str, dict[str, Any], dict[str, str], float], Response]


class SourceError(RuntimeError):
    """A request failed."""


class TransportError(SourceError):
    """There was no answer."""


class HttpError(SourceError):
    """The service answered with an HTTP error."""


class ApiError(SourceError):
    """The service answered with an error of its own."""


class ShapeError(SourceError):
    """The answer is not what the service promises."""


class RateLimiter:
    """At least ``interval`` seconds between two passes; the clock and the sleep can be replaced."""

    def __init__(self, interval: float, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep) -> None:
        self.interval, self.clock, self.sleep = interval, clock, sleep
        self.last: float | None = None

    def wait(self) -> None:
        if self.last is not None and (rest := self.interval - (self.clock() - self.last)) > 0:
            self.sleep(rest)
        self.last = self.clock()


def backoff(attempt: int, base: float = 1.0) -> float:
    """Seconds before attempt + 1: base, twice that, and so on."""
    return base * 2 ** (attempt - 1)


def _sent(transport: Transport, endpoint: str, params: dict[str, Any], headers: dict[str, str], timeout: float) -> Response:
    """The answer. What the transport raises may hold the whole address with its key, so only its type's name goes on."""
    try:
        return transport(endpoint, params, headers, timeout)
    except Exception as e:  # noqa: BLE001 - transports raise what they like
        raise TransportError(f"the request failed: {type(e).__name__}") from None


class PagedSource:
    """Pages of a user's events. Transient failures are tried again with growing waits; others, those of the transport
    included, raise at once. No secret reaches a message."""

    def __init__(
        self, transport: Transport, endpoint: str, method: str, user: str, api_key: str, timeout: float = 30, attempts: int = 6, wait: float = 1.0,
        sleep: Callable[[float], None] = time.sleep,
    ) -> None:
        self.transport, self.endpoint, self.method, self.user, self.api_key = transport, endpoint, method, user, api_key
        self.timeout, self.attempts, self.wait, self.sleep = timeout, attempts, wait, sleep

    def page(self, page: int = 1, limit: int = 200, since: int | None = None, until: int | None = None) -> dict:
        params: dict[str, Any] = {"method": self.method, "user": self.user, "api_key": self.api_key, "format": "json", "page": page, "limit": limit}
        params |= {k: v for k, v in (("from", since), ("to", until)) if v is not None}
        for attempt in range(1, self.attempts + 1):
            answer = _sent(self.transport, self.endpoint, params, {}, self.timeout)
            body = self._body(answer)
            code = body.get("error") if isinstance(body, dict) else None
            if answer.status_code not in TRANSIENT_STATUS and str(code).strip() != TRANSIENT_CODE:
                break
            if attempt < self.attempts:
                self.sleep(backoff(attempt, self.wait))
        if answer.status_code >= 400:
            raise HttpError(f"HTTP {answer.status_code}: {self._detail(answer, body)}")
        if code is not None:
            raise ApiError(f"error {code}: {redact(str(body.get('message', '')), self.api_key)}")
        listing = body.get("recenttracks") if isinstance(body, dict) else None
        if not isinstance(listing, dict) or not isinstance(listing.get("track", []), list):
            raise ShapeError("the answer has no list of tracks")
        return body

    @staticmethod
    def _body(answer: Response) -> Any:
        try:
            return answer.json()
        except ValueError:
            return None

    def _detail(self, answer: Response, body: Any) -> str:
        text = f"error {body.get('error')}: {body['message']}" if isinstance(body, dict) and body.get("message") is not None else answer.text[:300].strip()
        return redact(text, self.api_key)

    def pages(self, first: int = 1, since: int | None = None) -> Iterator[tuple[int, int, dict]]:
        """(page, pages in all, body) until the last or an empty page."""
        page = first
        while True:
            body = self.page(page, since=since)
            listing = body["recenttracks"]
            attrs = listing.get("@attr") if isinstance(listing.get("@attr"), dict) else {}
            try:
                total = max(1, int(attrs.get("totalPages", 1)))
            except (TypeError, ValueError):
                total = 1
            yield page, total, body
            if page >= total or not listing.get("track"):
                return
            page += 1


class EntityProvider:
    """Lookup of an artist by id, and search by name; no retries."""

    def __init__(self, transport: Transport, endpoint: str, agent: str, limiter: RateLimiter, timeout: float = 30) -> None:
        self.transport, self.endpoint, self.agent, self.limiter, self.timeout = transport, endpoint.rstrip("/"), agent, limiter, timeout

    def _get(self, path: str, params: dict[str, Any]) -> Response:
        self.limiter.wait()
        return _sent(self.transport, f"{self.endpoint}/{path}", params | {"fmt": "json"}, {"User-Agent": self.agent}, self.timeout)

    def by_id(self, ident: str) -> dict | None:
        answer = self._get(f"artist/{ident}", {})
        if answer.status_code == 404:
            return None
        if answer.status_code >= 400:
            raise HttpError(f"HTTP {answer.status_code}")
        return answer.json()

    def search(self, name: str, limit: int = 10) -> list[dict]:
        quoted = name.replace("\\", "\\\\").replace('"', '\\"')
        answer = self._get("artist", {"query": f'artist:"{quoted}"', "limit": limit})
        if answer.status_code >= 400:
            raise HttpError(f"HTTP {answer.status_code}")
        found = answer.json().get("artists")
        return found if isinstance(found, list) else []


class TagProvider:
    """Top tags of an artist; transport failures are tried three times, errors in an answer raise at once."""

    def __init__(self, transport: Transport, endpoint: str, api_key: str, limiter: RateLimiter, attempts: int = 3, sleep: Callable[[float], None] = time.sleep, timeout: float = 30) -> None:
        self.transport, self.endpoint, self.api_key, self.limiter = transport, endpoint, api_key, limiter
        self.attempts, self.sleep, self.timeout = attempts, sleep, timeout

    def top_tags(self, artist: str) -> dict:
        params = {"method": "artist.gettoptags", "artist": artist, "api_key": self.api_key, "format": "json"}
        for attempt in range(1, self.attempts + 1):
            self.limiter.wait()
            try:
                answer = _sent(self.transport, self.endpoint, params, {}, self.timeout)
                if answer.status_code < 400:
                    break
                failure: SourceError = HttpError(f"HTTP {answer.status_code}")
            except TransportError as e:
                failure = e
            if attempt == self.attempts:
                raise failure from None
            self.sleep(backoff(attempt))
        body = answer.json()
        if isinstance(body, dict) and "error" in body:
            raise ApiError(f"error {body['error']}: {redact(str(body.get('message', '')), self.api_key)}")
        return body
