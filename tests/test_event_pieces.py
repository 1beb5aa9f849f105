import pyarrow as pa

from leafmill.functions import markup


def test_events_are_given_away_before_a_batch_of_pages_ends(monkeypatch):
    monkeypatch.setattr(markup, "HELD_CHARS", 100)
    pages = [f"<p class='c{k}'>{'x' * 30}</p>" if k % 5 else None for k in range(40)]
    pieces = list(markup._events(iter([pa.array(pages[:25], pa.string()), pa.array(pages[25:], pa.string()), pa.array([], pa.string())])))
    assert len(pieces) > 10 and max(len(p) for p in pieces) <= 5
    rows = [r for p in pieces for r in p.to_pylist()]
    assert len(rows) == 40
    assert [r[0]["attrs"][0][1] if r else None for r in rows] == [f"c{k}" if k % 5 else None for k in range(40)]
