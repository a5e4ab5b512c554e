"""A text client with timeouts and bounded retries, to be given to ``operators.context.answers``."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass, field


class Busy(Exception):
    """The service asks to come back later."""


class Refused(Exception):
    """The service refuses more requests; trying again is no use."""


@dataclass
class HttpText:
    """A ``send`` for :class:`RetryingClient` over HTTP: posts ``make(prompt)`` as JSON, takes the text by ``read``.

    Status 503 is :class:`Busy`, 429 :class:`Refused`; any other failure is the error it is.
    """

    url: str
    make: Callable[[str], dict]
    read: Callable[[dict], str]
    headers: dict[str, str] = field(default_factory=dict)

    def __call__(self, prompt: str, timeout: float) -> str:
        body = json.dumps(self.make(prompt)).encode()
        request = urllib.request.Request(self.url, body, {"Content-Type": "application/json", **self.headers})
        try:
            with urllib.request.urlopen(request, timeout=timeout) as reply:
                return self.read(json.load(reply))
        except urllib.error.HTTPError as exc:
            kind = {503: Busy, 429: Refused}.get(exc.code)
            if kind is None:
                raise
            raise kind(str(exc)) from exc


@dataclass
class RetryingClient:
    """Calls ``send(prompt, timeout)`` up to ``attempts`` times; waits 2, 4, ... seconds when busy."""

    send: Callable[[str, float], str]
    attempts: int = 3
    timeout: float = 60.0
    wait: Callable[[float], None] = time.sleep

    def __call__(self, prompt: str) -> str:
        last: Exception | None = None
        for n in range(1, self.attempts + 1):
            try:
                return self.send(prompt, self.timeout)
            except Refused:
                raise
            except Exception as exc:  # noqa: BLE001
                last = exc
                if isinstance(exc, Busy) and n < self.attempts:
                    self.wait(2.0 * n)
        raise last  # type: ignore[misc]
