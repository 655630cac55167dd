"""Rules applied as edit scripts equal the same rules applied edit by edit, and cost about n log n."""

import copy
import random
import time

from yomibon.operators import refine


class OneByOne(refine.Chapter):
    """A chapter whose edits are never gathered."""

    def apart(self):
        return False


def tokens(rng, text, overlap):
    out, at = [], 0
    while at < len(text):
        n = rng.randint(1, 3)
        if rng.random() < 0.6 and at + n <= len(text):
            out.append({"surface": rng.choice([text[at : at + n], "x", ""]), "reading": rng.choice([text[at : at + n], "ab", None]), "fallback_reading": rng.choice([text[at : at + n], None]), "accent": None, "pos": rng.choice(["n", None]), "start": at, "end": at + n, "source": rng.choice(["ruby", "unidic", None])})
        at += rng.randint(0, n) if overlap else n
        at += overlap and rng.random() < 0.3
    return out


def rule(rng):
    pattern = rng.choice(["a", "ab", "b", "a+b?", "^a", "(?<=a)b", "abc", "b*"])
    made = {"pattern": pattern, "regex": any(c in pattern for c in "+^(*"), "replacement": rng.choice([None, "", "zz", "a", "abcd"]), "reading": rng.choice([None, "R", "ab"]), "surface": rng.choice([None, None, "x", "ab"])}
    return {**made, "match_surface": rng.choice([None, None, "ab"]), "source": rng.choice([None, None, "ruby"]), "pos": rng.choice([None, None, "n"]), "accent": rng.choice([None, 2])}


def test_edit_scripts_equal_single_edits():
    rng = random.Random(3)
    for turn in range(3000):
        text = "".join(rng.choice("abc ") for _ in range(rng.randint(0, 14)))
        own, original = tokens(rng, text, turn % 5 == 0), rng.choice([None, text, "".join(rng.choice("abc") for _ in range(8))])
        at_once, single = (kind(text, copy.deepcopy(own), original) for kind in (refine.Chapter, OneByOne))
        for _ in range(3):
            kind = rng.random()
            if kind < 0.7:
                one, source = rule(rng), rng.choice([None, None, "unidic"])
                for c in (at_once, single):
                    c.override(one, source)
            elif kind < 0.9:
                one, source = [{"surface": rng.choice(["x", None]), "reading": rng.choice(["ab", None])}], rng.choice([None, "ruby"])
                for c in (at_once, single):
                    c.remove(one, source)
            else:
                edits = sorted(((rng.randint(0, 5), rng.choice([None, "", "QQ"]), rng.choice([None, 1])) for _ in range(2)), key=lambda e: -e[0])
                for c in (at_once, single):
                    c.edit(edits)
            assert (at_once.text, at_once.tokens) == (single.text, single.tokens)


def test_rules_take_no_square_of_time():
    def taken(n):
        chapter = refine.Chapter("abc " * n, [{"surface": "abc", "reading": "abc", "start": 4 * k, "end": 4 * k + 3, "source": "ruby"} for k in range(n)])
        start = time.perf_counter()
        chapter.override({"pattern": "abc", "replacement": "abcd"})
        chapter.remove([{"surface": "abc"}])
        return time.perf_counter() - start

    taken(1000)
    assert taken(32_000) < 40 * max(taken(2000), 0.01)
