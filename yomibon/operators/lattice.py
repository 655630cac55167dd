"""Morphological tokens: the cheapest path through the lattice of dictionary words and unknown runs.

A word (surface, reading, class, cost) costs its own cost and, behind a word of another class, that of
the connection. Costs are whole thousandths of log10, estimated from evidence (`word_costs`,
`connection_costs`), so sums are exact. Dictionary words come as matches of a dictionary table
(dictionary.occurrences), whatever its size. Between them a text is cut in unknown words by character class:
from every place one unknown word runs to the end of its run of one class, and one takes a single
character, so a path always exists.

Of paths of equal cost the one with fewer words wins; then, at each word, the one whose last word begins
first, then the lesser class before it, then the lesser reading. So of a surface's words of one class only the cheapest
can be on a path, and no other goes to the texts. The best path of a text is found by one pass over its places. Tasks hold a
dictionary of few bytes and find its words by themselves, piece by piece; of a larger one its matches are joined by text.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.kana import NARROW_CJK
from ..functions.slices import by_row
from ..storage import written
from .dictionary import HELD_BYTES, held, lengths_by_first, occurrences

#: Character classes of unknown words, in the order in which they are tried; all else is "other".
CLASSES = (("space", r"\s"), ("digit", r"\p{Nd}"), ("kanji", NARROW_CJK), ("kana", r"[\x{3041}-\x{309F}\x{30A0}-\x{30FF}]"), ("latin", "[A-Za-zＡ-Ｚａ-ｚ]"))
OTHER, BOUND, BLANKS = "other", "bound", "space"
#: White space as it is in CLASSES, and pieces of texts that end in it; the classes' patterns in Python (digits aside, which Python knows by itself).
BLANK = r" \t\n\x0b\f\r"
PIECE = re.compile(f"[^{BLANK}]*[{BLANK}]+|[^{BLANK}]+")
PATTERNS = {name: re.compile(f"[{BLANK}]" if name == "space" else re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: chr(int(m[1], 16)), p)) for name, p in CLASSES if name != "digit"}
#: Pieces of at most so many characters are remembered, at most so many at a time.
REMEMBERED, MEMO = 64, 1 << 15
#: Below a path's cost are so many bits for the number of its words.
COUNT = 32
#: Costs of an unknown word, and of each of its characters; of a connection never seen.
UNKNOWN, UNKNOWN_EACH, UNSEEN = 6000, 500, 4000

TOKEN = T.StructType().add("start", "long").add("end", "long").add("surface", "string").add("reading", "string").add("class", "string")
PATH = T.StructType().add("cost", "long").add("tokens", T.ArrayType(TOKEN))


def class_of(char: Column) -> Column:
    found = F.lit(OTHER)
    for name, pattern in reversed(CLASSES):
        found = F.when(char.rlike(f"^{pattern}"), F.lit(name)).otherwise(found)
    return found


def cost_of(n: Column, total: Column) -> Column:
    """Thousandths of -log10 of a share."""
    return F.floor(-1000 * F.log10(n / total) + 0.5).cast("long")


def word_costs(sightings: DataFrame) -> DataFrame:
    """sightings (surface, reading): evidence -> key, readings: a row a surface, its words' (reading, class, cost) by reading. The class is its first character's."""
    counts = sightings.groupBy("surface", "reading").agg(F.count(F.lit(1)).alias("n"))
    total = sightings.agg(F.count(F.lit(1)).alias("total"))
    words = counts.crossJoin(F.broadcast(total)).select("surface", F.struct("reading", class_of(F.col("surface")).alias("class"), cost_of(F.col("n"), F.col("total")).alias("cost")).alias("word"))  # one row of totals
    return words.groupBy(F.col("surface").alias("key")).agg(F.array_sort(F.collect_list("word")).alias("words"))


def connection_costs(sightings: DataFrame, *keys: str, order: str) -> dict[tuple[str, str], int]:
    """sightings (keys..., order, surface): words in order -> costs of (class, next class); at most as many as pairs of classes."""
    place = Window.partitionBy(*keys).orderBy(order)
    rows = sightings.select(*keys, order, class_of(F.col("surface")).alias("right")).withColumn("left", F.coalesce(F.lag("right").over(place), F.lit(BOUND)))
    return costs_of(rows)


def connection_costs_of_rows(texts: DataFrame, surfaces: str) -> dict[tuple[str, str], int]:
    """The same of rows that hold the words of a text each, in order, as an array: nothing is shuffled but counts."""
    rows = texts.select(F.transform(surfaces, class_of).alias("right"))
    pairs = F.arrays_zip(F.concat(F.array(F.lit(BOUND)), "right").alias("left"), F.col("right"))
    return costs_of(rows.select(F.inline(pairs).alias("left", "right")).where("right is not null"))


def costs_of(rows: DataFrame) -> dict[tuple[str, str], int]:
    """rows (left, right): a row a pair of neighbours."""
    counts = rows.groupBy("left", "right").agg(F.count(F.lit(1)).alias("n"))
    costs = counts.withColumn("total", F.sum("n").over(Window.partitionBy("left"))).select("left", "right", cost_of(F.col("n"), F.col("total")).alias("cost"))
    return {(r.left, r.right): r.cost for r in costs.collect()}


class Links(dict):
    """Costs of connections by (class, next class), above the bits in which the words of a path are counted."""

    def __missing__(self, pair: tuple[str, str]) -> int:
        found = self[pair] = UNSEEN << COUNT
        return found


def links_of(connections: dict[tuple[str, str], int]) -> Links:
    return Links({pair: cost << COUNT for pair, cost in connections.items()})


def best_path(classes: list[str], words: list[tuple], text: str, connections: dict[tuple[str, str], int]) -> tuple[int, list[tuple]]:
    """classes: of each character; words (start, end, class, cost, reading), sorted: the cheapest path's cost, and its words."""
    starting: list[list[tuple]] = [[] for _ in text]
    for start, end, c, cost, reading in words:
        starting[start].append((end, c, (cost << COUNT) + 1, reading))
    cost, path = passed(classes, starting, links_of(connections))
    return cost, [(start, end, text[start:end], reading, c) for start, end, reading, c in path]


def passed(classes: list[str], starting: list[list[tuple]], links: Links, before: str = BOUND, behind: str | None = None) -> tuple[int, list[tuple]]:
    """The path's cost and its (start, end, reading, class). starting: at each place its words' (end, class, cost and one word, reading);
    before: the class of what comes before; behind: of what follows, if something does."""
    n = len(classes)
    if not n:
        return 0, []
    ends = [n] * n
    for k in range(n - 2, -1, -1):
        if classes[k] != classes[k + 1]:
            ends[k] = k + 1
        else:
            ends[k] = ends[k + 1]
    # For each place and class of the word that ends there: (cost and number of words, start, class before, reading as it is compared, reading).
    best: list[dict[str, tuple] | None] = [None] * (n + 1)
    best[0] = {before: (0, -1, "", "", None)}
    single, each = (UNKNOWN + UNKNOWN_EACH << COUNT) + 1, UNKNOWN_EACH << COUNT
    for at in range(n):
        states = best[at]
        if states is None:
            continue
        own, end = classes[at], ends[at]
        after = [*starting[at], (at + 1, own, single, None)]
        if end > at + 1:
            after.append((end, own, single + each * (end - at - 1), None))
        behinds: dict[str, tuple] = {}
        for end, c, cost, reading in after:
            # What is best before a word depends on its class alone; of equal states the lesser class.
            known = behinds.get(c)
            if known is None:
                known = behinds[c] = min([(state[0] + links[b, c], b) for b, state in states.items()])
            total, ending = known[0] + cost, best[end]
            if ending is None:
                best[end] = {c: (total, at, known[1], reading or "", reading)}
                continue
            old = ending.get(c)
            # An earlier start was met before; of words from here the lesser reading.
            if old is None or total < old[0] or (total == old[0] and at == old[1] and (reading or "") < old[3]):
                ending[c] = (total, at, known[1], reading or "", reading)
    states = best[n]
    _, last = min([(state[0] + (links[c, behind] if behind else 0), c) for c, state in states.items()])
    cost, path, at, c = states[last][0] >> COUNT, [], n, last
    while at > 0:
        _, start, earlier, _, reading = best[at][c]
        path.append((start, at, reading, c))
        at, c = start, earlier
    return cost, path[::-1]


class Lattice:
    """A dictionary in memory (surface -> its words' (class, cost, reading)) and the cheapest paths of texts.

    No word without white space reaches over it, and behind a run of it a path is in one state, so a text falls into pieces that end in
    white space; short pieces are remembered, in a memo of bounded size. If a word has white space, a text is one piece.
    """

    def __init__(self, words: dict[str, list[tuple]], connections: dict[tuple[str, str], int]):
        self.words = {w: [(c, (cost << COUNT) + 1, reading) for c, cost, reading in found] for w, found in words.items()}
        self.lengths, self.links = lengths_by_first(words), links_of(connections)
        self.whole = any(re.search(f"[{BLANK}]", w) for w in words)
        self.classes: dict[str, str] = {}
        self.memo: dict[tuple[str, str], tuple[int, list[tuple]]] = {}

    def block(self, text: str, before: str = BOUND, behind: str | None = None) -> tuple[int, list[tuple]]:
        """passed() of a text, or of a part of one."""
        classes, starting, known, lengths = [], [], self.words, self.lengths
        for at, char in enumerate(text):
            c = self.classes.get(char)
            if c is None:
                c = self.classes[char] = class_in_python(char)
            classes.append(c)
            found = []
            for size in lengths.get(char, ()):
                word = text[at : at + size]
                if word in known:
                    end = at + len(word)
                    if end - at == size:
                        found += [(end, *w) for w in known[word]]
            starting.append(found)
        return passed(classes, starting, self.links, before, behind)

    def path(self, text: str) -> tuple[int, list[tuple]]:
        """The cost of a whole text's path, and its (start, end, reading, class)."""
        if self.whole:
            return self.block(text)
        total, path, before = 0, [], BOUND
        for m in PIECE.finditer(text):
            piece = m[0]
            found = self.memo.get((before, piece))
            if found is None:
                found = self.block(piece, before)
                if len(piece) <= REMEMBERED:
                    if len(self.memo) >= MEMO:
                        self.memo.clear()
                    self.memo[before, piece] = found
            at, before = m.start(), BLANKS
            total += found[0]
            path += [(a + at, b + at, reading, c) for a, b, reading, c in found[1]]
        return total, path


def class_in_python(char: str) -> str:
    """class_of() of one character."""
    for name, pattern in CLASSES:
        if char.isdecimal() if name == "digit" else PATTERNS[name].match(char):
            return name
    return OTHER


def path_of(text: str, cost: int, path: list[tuple]) -> dict:
    return {"cost": cost, "tokens": [{"start": a, "end": b, "surface": text[a:b], "reading": reading, "class": c} for a, b, reading, c in path]}


NO_PATH = {"cost": None, "tokens": None}


def pathfinder(connections: dict[tuple[str, str], int]):
    """An Arrow-batched function of (text, classes, words)."""

    @by_row(PATH)
    def found(text, classes, words):
        if text is None:
            return NO_PATH
        cost, path = best_path(classes, sorted((x["start"], x["end"], w["class"], w["cost"], w["reading"]) for x in words or () for w in x["words"]), text, connections)
        return {"cost": cost, "tokens": [dict(zip(TOKEN.names, t, strict=True)) for t in path]}

    return found


def holding_pathfinder(shared, connections: dict[tuple[str, str], int]):
    """The same of texts alone, with the dictionary at hand: surface -> its words' (class, cost, reading)."""
    made: list[Lattice] = []

    @by_row(PATH)
    def found(text):
        if not made:
            made.append(Lattice(shared.value, connections))
        return NO_PATH if text is None else path_of(text, *made[0].path(text))

    return found


def cheapest(words: DataFrame) -> DataFrame:
    """words of word_costs() with one word for each class of a key: the cheapest, of those the lesser reading."""
    rows = words.where("key <> ''").select("key", F.explode("words").alias("w")).groupBy("key", F.col("w.class").alias("class"))
    best = rows.agg(F.min(F.struct("w.cost", F.coalesce("w.reading", F.lit("")).alias("said"), "w.reading")).alias("best"))
    return best.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("class", "best.cost", "best.reading"))).alias("words"))


def paths(docs: DataFrame, words: DataFrame, connections: dict[tuple[str, str], int], *keys: str, held_bytes: int = HELD_BYTES, **options) -> DataFrame:
    """docs (keys..., text) with distinct keys, words of word_costs() -> keys..., text, path: struct(cost, tokens). A null text has none, an empty one an empty path."""
    known = written(cheapest(words), "words")
    rows = held(known, held_bytes)
    if rows is not None:
        shared = docs.sparkSession.sparkContext.broadcast({r.key: [tuple(w) for w in r.words] for r in rows})
        return docs.select(*keys, "text", holding_pathfinder(shared, connections)("text").alias("path"))
    classes = F.transform(F.filter(F.split("text", ""), lambda c: c != ""), class_of)
    met = occurrences(docs, known, *keys, context=(), **options).groupBy(*keys).agg(F.collect_list(F.struct("start", "end", "words")).alias("met"))
    rows = docs.select(*keys, "text").join(met, list(keys), "left")
    return rows.select(*keys, "text", pathfinder(connections)("text", classes, "met").alias("path"))


def tokens(docs: DataFrame, words: DataFrame, connections: dict[tuple[str, str], int], *keys: str, **options) -> DataFrame:
    """docs (keys..., text) -> keys..., idx, start, end, surface, reading (null: unknown), class."""
    rows = paths(docs, words, connections, *keys, **options).select(*keys, F.posexplode("path.tokens").alias("idx", "t"))
    return rows.select(*keys, F.col("idx").cast("long").alias("idx"), "t.*")
