"""What a connector needs beside its pages: bounded retries, and batches that isolate a bad key."""

from __future__ import annotations

import datetime as dt
import email.utils
import time
from collections.abc import Callable
from dataclasses import dataclass

# Statuses worth another attempt.
RETRY = (429, 502, 503, 504)


def retry_delay(value: str | None, now: dt.datetime | None = None) -> float | None:
    """Seconds that a Retry-After header asks for, as a number or a date; past dates ask for none."""
    text = (value or "").strip()
    if text.isdigit():
        return float(text)
    try:
        at = email.utils.parsedate_to_datetime(text)
    except (TypeError, ValueError):
        return None
    if at.tzinfo is None:
        at = at.replace(tzinfo=dt.timezone.utc)
    return max(0.0, (at - (now or dt.datetime.now(dt.timezone.utc))).total_seconds())


@dataclass
class Response:
    status: int
    value: object = None
    retry_after: str | None = None


class StatusError(RuntimeError):
    def __init__(self, status: int, attempts: int, value: object):
        super().__init__(f"status {status} after {attempts} attempts")
        self.status, self.attempts, self.value = status, attempts, value


def with_retries(attempt: Callable[[], Response], retries: int = 3, base: float = 1.0, most: float = 30.0, sleep: Callable[[float], None] = time.sleep) -> object:
    """The value of the first success; 429 and gateway failures are tried again, at most ``retries`` times."""
    for used in range(retries + 1):
        r = attempt()
        if 200 <= r.status < 300:
            return r.value
        if r.status not in RETRY or used == retries:
            raise StatusError(r.status, used + 1, r.value)
        asked = retry_delay(r.retry_after)
        sleep(min(most, asked if asked is not None else base * 2**used))
    raise AssertionError


class BadKey(ValueError):
    """One of the keys of a batch spoils it."""


def resolve_batch(keys: list[str], fetch: Callable[[list[str]], dict[str, object]]) -> tuple[dict[str, object], list[str]]:
    """Found values and missing keys. A batch that a key spoils is halved until the key is alone;
    keys an answer leaves out are asked for one by one before they count as missing."""
    if not keys:
        return {}, []
    try:
        found = dict(fetch(keys))
    except BadKey:
        if len(keys) == 1:
            return {}, keys
        half = len(keys) // 2
        (a, lost_a), (b, lost_b) = resolve_batch(keys[:half], fetch), resolve_batch(keys[half:], fetch)
        return a | b, lost_a + lost_b
    missing = []
    for key in (k for k in keys if k not in found):
        try:
            one = fetch([key]) if len(keys) > 1 else {}
        except BadKey:
            one = {}
        if key in one:
            found[key] = one[key]
        else:
            missing.append(key)
    return found, missing
