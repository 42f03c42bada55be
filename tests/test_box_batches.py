"""Boxes of a batch of pages."""

import pyarrow as pa

from weftmatch.operators import boxes as bx


def test_boxes_of_a_batch_are_folded_a_page_at_a_time(monkeypatch):
    pages = pa.array([[{"y": 1.0, "height": 10.0}, {"y": 3.0, "height": 10.0}, {"y": 30.0, "height": 10.0}], None, []])
    alive = []
    monkeypatch.setattr(bx, "fold_lines", lambda boxes, own=bx.fold_lines: (alive.append(len(boxes)), own(boxes))[1])

    class Rows:
        """Rows that may not be made Python objects together."""

        def __iter__(self):
            return iter(pages)

        def __len__(self):
            return len(pages)

    assert bx._line_numbers(Rows()).to_pylist() == [[0, 0, 1], None, []] and alive == [3, 0]
