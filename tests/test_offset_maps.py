"""Maps of offsets between two versions of a text: minimal on small ones, whole and near linear on long ones."""

import random
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from yomibon.operators import offset_maps
from yomibon.operators.offset_maps import aligned

TEXTS = st.text(alphabet="ab山\U0001f600", max_size=40)


def least_changes(x: str, y: str) -> int:
    row = list(range(len(y) + 1))
    for i, c in enumerate(x, 1):
        last, row[0] = row[0], i
        for j, d in enumerate(y, 1):
            last, row[j] = row[j], last if c == d else 1 + min(row[j], row[j - 1])
    return row[-1]


def holds(x: str, y: str, found) -> None:
    """Runs are equal texts, in order and apart, and none goes on where another ends."""
    a_end = b_end = 0
    for k, (a, b, n) in enumerate(zip(found.a.tolist(), found.b.tolist(), found.n.tolist(), strict=True)):
        assert n > 0 and a >= a_end and b >= b_end and x[a : a + n] == y[b : b + n]
        assert k == 0 or (a, b) != (a_end, b_end)
        a_end, b_end = a + n, b + n
    assert a_end <= len(x) and b_end <= len(y)


@settings(max_examples=300, deadline=None)
@given(TEXTS, TEXTS)
def test_small_texts_have_least_changes(x, y):
    found = aligned(x, y)
    holds(x, y, found)
    assert found.changes == least_changes(x, y)
    mapped = found.mapped(range(-2, len(y) + 3)).tolist()
    assert mapped == sorted(mapped) and mapped[:3] == [0, 0, 0] and set(mapped[len(y) + 3 :]) == {len(x)}


@settings(max_examples=150, deadline=None)
@given(TEXTS, TEXTS)
def test_halves_have_least_changes_too(x, y):
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(offset_maps, "CELLS", 12)
        patch.setattr(offset_maps, "PIECES", ())
        found = aligned(x, y)
    holds(x, y, found)
    assert found.changes == least_changes(x, y)


@settings(max_examples=150, deadline=None)
@given(TEXTS, TEXTS, st.sampled_from([(2,), (4, 2), (3, 1)]))
def test_anchored_texts_hold(x, y, pieces):
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(offset_maps, "CELLS", 8)
        patch.setattr(offset_maps, "PIECES", pieces)
        holds(x, y, aligned(x, y))


def edited(text: str, rng: random.Random, every: int) -> tuple[str, int]:
    out, changes = [], 0
    for k, c in enumerate(text):
        if k % every == every // 2:
            kind = rng.randrange(3)
            out.append(["", c + "≪", "≫"][kind])
            changes += [1, 1, 2][kind]
        else:
            out.append(c)
    return "".join(out), changes


def test_long_texts_are_aligned_in_whole_and_near_linearly():
    rng = random.Random(1)
    seconds = []
    for size in (50_000, 400_000):
        x = "".join(rng.choice("abcdefghijklmnop ") for _ in range(size))
        y, changes = edited(x, rng, 97)
        start = time.process_time()
        found = aligned(x, y)
        seconds.append(time.process_time() - start)
        holds(x, y, found)
        assert found.changes <= changes
    assert seconds[1] < 8 * 4 * max(seconds[0], 0.05)  # the square would be 64 times


def test_long_texts_without_anchors():
    assert aligned("ab" * 5000, "ab" * 4000).changes == 2000
    assert aligned("a" * 3000, "b" * 3000).changes == 6000
    assert aligned("a" * 3000 + "x", "b" * 3000 + "x" + "c" * 3000).changes == 9000
    assert aligned("", "abc").mapped([0, 1, 3, 4]).tolist() == [0, 0, 0, 0]
    assert aligned("abc", "").mapped([0, 1]).tolist() == [0, 3]
    assert aligned("", "").mapped([]).tolist() == []


def test_changed_parts_are_spread_to_the_even_number():
    found = aligned("xx12345yy", "xxABCDEFGHIJyy")
    assert found.mapped(range(2, 13)).tolist() == [2, 2, 3, 4, 4, 4, 5, 6, 6, 6, 7]
