import pandas as pd

from wardenflow.streaming.log_stream import detector


class State:
    hasTimedOut = exists = False

    def update(self, new):
        self.held = new


def test_rows_of_several_arrow_batches_are_in_time_order():
    row = lambda ms: ("a", ms, ms, True, False, False, False)
    frame = lambda *ms: pd.DataFrame([row(x) for x in ms], columns=["ip", "ms", "idx", "failed", "success", "error", "hit"])
    step = detector(60_000, failures=3, errors=3, requests=100, idle_ms=None)
    (got,) = step(("a",), iter([frame(200_000, 100_000), frame(102_000, 101_000)]), state := State())
    assert got.values.tolist() == [["a", "brute-force", 102_000, 100_000, 3]]
    assert state.held[2] == [200_000]
