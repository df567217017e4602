"""Pagination, retries and error classes, with scripted providers."""

import pytest

from loghaven.errors import ProviderError
from loghaven.functions import eventset as E
from loghaven.sources import provider as P
from tests.helpers import a, b, h, logs_frame, raw_log


class FakeClock:
    def __init__(self):
        self.t, self.slept = 0.0, []

    def now(self):
        return self.t

    def sleep(self, seconds):
        self.t += seconds
        self.slept.append(seconds)


class Scripted:
    """Refuses windows over a cap; keeps the accepted ones."""

    def __init__(self, cap=None, text="query returned more than 10000 results", refuse=()):
        self.cap, self.text, self.refuse, self.asked, self.accepted = cap, text, refuse, [], []

    def __call__(self, low, high):
        self.asked.append((low, high))
        if (self.cap and high - low + 1 > self.cap) or any(low <= n <= high for n in self.refuse):
            raise ProviderError(self.text)
        self.accepted.append((low, high))
        return (low, high)


def walk(scripted, low, high, **kw):
    clock = FakeClock()
    P.Paginator(scripted, clock, **kw).walk(low, high)
    ends = [low - 1, *(x[1] for x in scripted.accepted)]
    assert [x[0] for x in scripted.accepted] == [e + 1 for e in ends[:-1]] and ends[-1] == high
    return clock


def test_windows_without_limits():
    s = Scripted()
    walk(s, 0, 2_500_000)
    assert len(s.accepted) == 3


def test_result_cap_halves_and_ramps():
    s = Scripted(1000)
    clock = walk(s, 0, 10_000)
    first = next(i for i, x in enumerate(s.asked) if x in s.accepted)
    span = s.asked[first][1] - s.asked[first][0] + 1
    assert span == 976 and s.asked[first + 1][1] - s.asked[first + 1][0] + 1 == 2 * span
    assert clock.slept == [1.0] * (len(s.asked) - len(s.accepted))


@pytest.mark.parametrize(("cap", "high", "calls", "slept"), [(16, 1000, 120, 20), (500_000, 3_999_999, 16, 2)])
def test_span_cap_is_kept(cap, high, calls, slept):
    s = Scripted(cap, "block range limit exceeded")
    clock = walk(s, 0, high)
    assert len(s.asked) < calls and sum(clock.slept) <= slept
    first = s.asked.index(s.accepted[0])
    assert s.asked[first:] == s.accepted


def test_configured_span_cap():
    s = Scripted()
    clock = walk(s, 0, 109, span_cap=16)
    assert len(s.asked) == 7 and not clock.slept


def test_failures():
    with pytest.raises(P.SingleBlockOverflow) as found:
        P.Paginator(Scripted(refuse=[100]), FakeClock()).walk(100, 100)
    assert found.value.block == 100
    with pytest.raises(ProviderError, match="failed to get logs for range 5-10"):
        P.Paginator(Scripted(refuse=[7], text="boom"), FakeClock()).walk(5, 10)
    s = Scripted()
    found, expired = P.Paginator(s, FakeClock()).walk(0, 2_000_000, lambda: len(s.accepted) == 1)
    assert expired and len(found) == 1


def test_dense_block_from_receipts(spark):
    rows = [raw_log(100, 0, a(1), [E.URI, h(1)]), raw_log(101, 1, a(1), [E.URI, h(1)], tx=3), raw_log(101, 2, a(1), [E.URI, h(1)], tx=4), raw_log(101, 3, a(1), [h(9)], tx=4), raw_log(102, 0, a(1), [E.URI, h(1)])]
    logs = logs_frame(spark, rows)

    class Dense(P.FrameProvider):
        def filter_logs(self, low, high, topics):
            assert low <= high
            if low <= 101 <= high:
                raise ProviderError("too many results")
            return super().filter_logs(low, high, topics)

    got = P.Fetcher(Dense(None, logs), FakeClock()).fetch(100, 102)
    assert sorted((r["block_number"], r["log_index"]) for r in got.collect()) == [(100, 0), (101, 1), (101, 2), (102, 0)]
    got = P.Fetcher(Dense(None, logs), FakeClock()).fetch(101, 102)
    assert got.count() == 3


def test_error_classes():
    for text in ("range 9999999 exceeds limit of 10000", "Block range limit exceeded.", "query exceeds max block range 100000", "eth_getLogs is limited to 1024 block range", "block range is too wide"):
        assert P.is_span_cap(ProviderError(text)) and P.is_too_large(ProviderError(text))
    for text in ("query returned more than 10000 results", "query returns too many logs, narrow your filter: 20000", "query exceeds max results 20000"):
        assert P.is_too_large(ProviderError(text)) and not P.is_span_cap(ProviderError(text))
    coded = ProviderError("invalid range")
    coded.code = -32602
    assert P.is_span_cap(coded) and not P.is_too_large(ProviderError("execution reverted"))
    assert P.is_retryable(ProviderError("unexpected EOF")) and P.is_retryable(ConnectionError()) and not P.is_retryable(ProviderError("no"))


def test_retry_and_redaction():
    clock, tries = FakeClock(), []

    def flaky():
        tries.append(1)
        if len(tries) < 4:
            raise ProviderError("503")
        return "ok"

    assert P.Retry(clock)("x", flaky) == "ok" and len(clock.slept) == 3
    assert all(w * 0.5 <= s <= w * 1.5 for w, s in zip((5, 10, 20), clock.slept, strict=True))
    with pytest.raises(ProviderError, match="failed after retries"):
        P.Retry(clock)("x", lambda: (_ for _ in ()).throw(ProviderError("bad gateway")))
    with pytest.raises(ProviderError, match="permanent"):
        P.Retry(clock)("x", lambda: (_ for _ in ()).throw(ProviderError("denied at https://u:p@host.example/v3/KEY?x=1")))
    assert P.redact("dial wss://u:p@host.example:1/v3/KEY?x: no") == "dial wss://host.example:1 no"
    assert b("00") == b"\0"
