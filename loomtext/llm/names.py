"""Problem 5: variant spellings of names.

Different spellings are handled once, however often they occur.

1. Habits are learned from rows that are resolved already, aligned word by word
   with the names of their entity: short forms and nicknames (a word that
   stands for another one), words that are added to names or left out of them,
   and how often each kind of change happens. No list of titles, places, firm
   endings or given names is written down.
2. Words are looked up by a trie join. Known words lie in cells by their length
   and number of letters up to m; a spelled word visits the cells it can reach
   within the edit bound, whose number is fixed, so its work does not grow with
   the number of cells. The words of a cell are one trie, walked by the sorted
   spelled words together: the set of trie nodes within the edit bound of a
   prefix (insertions, deletions, substitutions, swapped letters, also with a
   letter between them) is derived from that of the prefix before it and shared
   by all words that begin alike.
3. Spellings meet names through the rarest words of each name, their heads and
   the initials of long names, by joins on these keys.
4. A candidate stands if every word of the spelling can be assigned to a
   different word of the name, in any order, as the word itself, a misspelling,
   an initial, a cut word or a learned short form. The costs are the negative
   logarithms of the learned rates.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from math import log

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import scratch
from ..operators.stitch import normal_qid

EDITS = 2
#: Letters that a cut-off word keeps at least, words of a name that has an acronym, words of a spelling whose parts are put together.
CUT, ACRONYM, JOINED = 4, 3, 6
#: Different entities a habit must be seen with, and the least share of a word's uses in which it is left out.
SUPPORT, LEAVING = 2, 0.002
#: A word is a short form if this share of its uses stands for the TOP_FULL words it stands for most; a word that stands for anything is an addition.
SPECIFIC, TOP_FULL = 0.8, 4
#: Habits kept at most, those of most support first; they go to every task.
MAX_HABITS = 50_000
#: Known words up to which they form one cell, cells by length, and cells by length and letters beyond.
ONE_CELL, BY_LENGTH = 200_000, 4_000_000
#: Spelled words walked together at least, and no fewer than the cell has known words, so that building a trie costs no more than walking it.
BLOCK = 2_000
_LONGEST = 63
_WORD = re.compile("[a-z]+")


def name_words(text: str) -> list[str]:
    """Words of a name, accents taken off, lower-cased."""
    plain = unicodedata.normalize("NFKD", text)
    return _WORD.findall("".join(c for c in plain if not unicodedata.combining(c)).replace("'", "").replace("’", "").lower())


def spelling_of(c: Column) -> Column:
    """The form under which equal spellings are handled once."""
    t = F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))
    return F.when(t.rlike("[a-z\\u00c0-\\u024f]"), t)


def known_names(kb_search: DataFrame) -> DataFrame:
    """(qid, name): labels and mentions of the entities of the search cache."""
    rows = kb_search.select(normal_qid(F.col("record.qid")).alias("qid"), F.explode(F.array("mention", "record.label")).alias("name"))
    return rows.select("qid", spelling_of(F.col("name")).alias("name")).where("qid is not null and name is not null").distinct()


class Trie:
    """Words as a trie in lists; a walk keeps the active nodes of a growing prefix with their distances."""

    def __init__(self, words: list[str], bound: int):
        self.bound = bound
        self.next: list[dict[str, int]] = [{}]
        self.word: list[str | None] = [None]
        for w in words:
            at = 0
            for c in w:
                to = self.next[at].get(c)
                if to is None:
                    to = self.next[at][c] = len(self.next)
                    self.next.append({})
                    self.word.append(None)
                at = to
            self.word[at] = w
        self.start = self._closed({0: 0})

    def _closed(self, active: dict[int, int]) -> dict[int, int]:
        """Add the nodes reached by letters that the prefix lacks."""
        queue = list(active.items())
        for node, d in queue:
            if d < self.bound and active[node] == d:
                for child in self.next[node].values():
                    if active.get(child, 99) > d + 1:
                        active[child] = d + 1
                        queue.append((child, d + 1))
        return active

    def step(self, active: dict[int, int], c: str, older: dict[int, int] | None, before: str, oldest: dict[int, int] | None, first: str) -> dict[int, int]:
        """Active nodes after one more letter; older and before: the active nodes one letter earlier, and the last letter; oldest and first: the same of the letter before."""
        out: dict[int, int] = {}
        for node, d in active.items():
            if d < self.bound and out.get(node, 99) > d + 1:
                out[node] = d + 1
            for letter, child in self.next[node].items():
                e = d if letter == c else d + 1
                if e <= self.bound and out.get(child, 99) > e:
                    out[child] = e
        if older is not None and before != c:
            for node, d in older.items():
                if d < self.bound:
                    mid = self.next[node].get(c)
                    end = self.next[mid].get(before) if mid is not None else None
                    if end is not None and out.get(end, 99) > d + 1:
                        out[end] = d + 1
                    if mid is not None and d + 2 <= self.bound:  # swapped letters that stand apart in the known word
                        for between in self.next[mid].values():
                            end = self.next[between].get(before)
                            if end is not None and out.get(end, 99) > d + 2:
                                out[end] = d + 2
        if oldest is not None and first != c:
            for node, d in oldest.items():  # swapped letters that stand apart in the spelling
                if d + 2 <= self.bound:
                    mid = self.next[node].get(c)
                    end = self.next[mid].get(first) if mid is not None else None
                    if end is not None and out.get(end, 99) > d + 2:
                        out[end] = d + 2
        return self._closed(out)

    def neighbours(self, words: list[str]) -> dict[str, dict[str, int]]:
        """For each of the sorted distinct words, the words of the trie within the bound and their distances."""
        found: dict[str, dict[str, int]] = {}
        stack, last = [self.start], ""
        for w in words:
            keep = 0
            while keep < min(len(w), len(last)) and w[keep] == last[keep]:
                keep += 1
            keep = min(keep, len(stack) - 1)
            del stack[keep + 1 :]
            for i in range(keep, len(w)):
                stack.append(self.step(stack[i], w[i], *((stack[i - 1], w[i - 1]) if i else (None, "")), *((stack[i - 2], w[i - 2]) if i > 1 else (None, ""))))
                if not stack[-1]:
                    break
            last = w[: len(stack) - 1]
            hits = {self.word[n]: d for n, d in stack[-1].items() if self.word[n] is not None} if len(stack) == len(w) + 1 else {}
            if hits:
                found[w] = hits
        return found


def edits(a: str, b: str, bound: int = EDITS) -> int:
    """Insertions, deletions, substitutions and swaps of neighbours between two words; bound + 1 if more."""
    if abs(len(a) - len(b)) > bound:
        return bound + 1
    older, last = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            d = min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y))
            if older is not None and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, older[j - 2] + 1)
            row.append(d)
        if min(row) > bound:
            return bound + 1
        older, last = last, row
    return min(last[-1], bound + 1)


def edit_limit(a: str, b: str) -> int:
    """Edits allowed between two words: none for very short ones."""
    short = min(len(a), len(b))
    return EDITS if short >= 5 else 1 if short >= 3 else 0


@dataclass
class Habits:
    """What is learned from resolved rows."""

    #: Short form to the words it stands for.
    full: dict[str, list[str]] = field(default_factory=dict)
    #: Words added to names, and words left out of them.
    added: set[str] = field(default_factory=set)
    left: set[str] = field(default_factory=set)
    #: How often each kind of change was seen; `same` counts unchanged words.
    seen: dict[str, int] = field(default_factory=dict)

    def costs(self) -> dict[str, float]:
        """Cost of each kind of change, never nothing."""
        total = sum(self.seen.values()) + 20
        return {k: -log((self.seen.get(k, 0) + 1) / total) for k in ("edit1", "edit2", "initial", "short", "cut", "added", "left", "acronym")}


def aligned(spelling: list[str], name: list[str], added: frozenset[str] = frozenset()) -> list[tuple[str, str, str]]:
    """(kind, spelled word, known word) of the changes between a spelling and a name of its entity, the plainest reading first; `added` are words known to be additions."""
    out: list[tuple[str, str, str]] = []
    if len(name) >= ACRONYM and "".join(spelling) in {"".join(w[0] for w in name), "".join(w[0] for w in name if len(w) > 3)} and (len(spelling) == 1 or all(len(w) == 1 for w in spelling)):
        return [("acronym", "", "")]
    rest_s, rest_n = [], list(name)
    for w in spelling:
        if w in rest_n:
            rest_n.remove(w)
            out.append(("same", w, w))
        elif w in added:
            out.append(("added", w, ""))
        else:
            rest_s.append(w)

    def pair(kind: str, fits) -> None:
        for w in list(rest_s):
            got = next((n for n in rest_n if fits(w, n)), None)
            if got is not None:
                rest_s.remove(w)
                rest_n.remove(got)
                out.append((kind, w, got))

    for d in range(1, EDITS + 1):
        pair(f"edit{d}", lambda w, n, d=d: d <= edit_limit(w, n) and edits(w, n, d) == d)
    pair("initial", lambda w, n: len(w) == 1 and n[0] == w)
    if not any(kind in ("same", "edit1", "edit2") for kind, _, _ in out):
        return []  # nothing says that this is the name meant
    if len(rest_s) == len(rest_n) == 1:
        out.append(("short", rest_s[0], rest_n[0]))
    elif rest_s and rest_n:
        pair("short", lambda w, n: len(w) > 1 and n[0] == w[0])
        out.extend(("added", w, "") for w in rest_s if not rest_n)
        out.extend(("left", "", n) for n in rest_n if not rest_s)
    else:
        out.extend(("added", w, "") for w in rest_s)
        out.extend(("left", "", n) for n in rest_n)
    return out


def _observe(added: frozenset[str]):
    """mapInArrow function to (kind, word, known, qid): one row a change, and a row `word` for each word of the name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for s, n, q in zip(b.column("spelling").to_pylist(), b.column("name").to_pylist(), b.column("qid").to_pylist()):
                name = name_words(n)
                seen = aligned(name_words(s), name, added)
                rows += [(k, w, f, q) for k, w, f in seen]
                rows += [("word", "", w, q) for w in name if seen]
            cols = list(zip(*rows)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols], ["kind", "word", "known", "qid"])

    return run


def _observed(pairs: DataFrame, added: frozenset[str]) -> DataFrame:
    """(kind, word, known, n, entities): the changes counted."""
    seen = pairs.mapInArrow(_observe(added), "kind string, word string, known string, qid string")
    return scratch.keep(seen.groupBy("kind", "word", "known").agg(F.count("*").alias("n"), F.countDistinct("qid").alias("entities")), "observed")


def _additions(counted: DataFrame) -> frozenset[str]:
    """Words of two letters or more that are added to names of SUPPORT entities, or take the place of so many different words that they stand for none."""
    by = counted.where("kind in ('short', 'added') and length(word) > 1").groupBy("word")
    stands, top = F.sum(F.when(F.col("kind") == "short", F.col("n")).otherwise(0)), F.slice(F.sort_array(F.collect_list(F.when(F.col("kind") == "short", F.col("n"))), False), 1, TOP_FULL)
    per = by.agg(F.sum("entities").alias("entities"), F.sum(F.when(F.col("kind") == "added", F.col("n")).otherwise(0)).alias("added"), stands.alias("stands"), F.aggregate(top, F.lit(0).cast("bigint"), lambda a, x: a + x).alias("top"))
    free = ((F.col("added") > 0) & (F.col("added") >= F.col("stands"))) | ((F.col("stands") > 0) & (F.col("top") < F.col("stands") * SPECIFIC))
    return frozenset(r[0] for r in per.where(free & (F.col("entities") >= SUPPORT)).orderBy(F.desc("entities"), "word").limit(MAX_HABITS).select("word").collect())


def learn(resolved: DataFrame, names: DataFrame) -> Habits:
    """Habits of the resolved spellings (spelling, qid) of entities with known names (qid, name).

    All rows count, each different spelling of an entity once, aligned with the
    name nearest in length. A habit needs SUPPORT entities, so no entity
    teaches anything on its own. Added words are learned first; with them put
    aside it shows which words are left out and which stand for others.
    """
    pairs = resolved.where("spelling is not null and qid is not null").distinct().join(names, "qid")
    pairs = pairs.groupBy("qid", "spelling").agg(F.min(F.struct(F.abs(F.length("name") - F.length("spelling")).alias("d"), "name")).alias("n"))
    pairs = scratch.keep(pairs.select("spelling", F.col("n.name").alias("name"), "qid"), "resolved")
    added = _additions(_observed(pairs, frozenset()))
    counted = _observed(pairs, added)
    out = Habits(added=set(added), seen={r[0]: r[1] for r in counted.where("kind <> 'word'").groupBy("kind").agg(F.sum("n")).collect()})  # one row a kind
    uses = counted.where("kind = 'word'").select("known", F.col("n").alias("uses"))
    strong = counted.where((F.col("kind").isin("short", "left")) & (F.col("entities") >= SUPPORT) & ((F.length("word") > 1) | (F.col("kind") == "left")))
    for r in strong.orderBy(F.desc("entities"), "kind", "word", "known").limit(MAX_HABITS).join(uses, "known").collect():
        if r["kind"] == "short":
            out.full.setdefault(r["word"], []).append(r["known"])
        elif r["n"] >= LEAVING * r["uses"]:
            out.left.add(r["known"])
    cut = counted.where(f"kind = 'short' and entities < {SUPPORT} and length(word) >= {CUT} and startswith(known, word)").agg(F.sum("n")).first()[0] or 0
    out.seen |= {"cut": cut, "short": out.seen.get("short", 0) - cut}
    out.full = {w: sorted(f) for w, f in sorted(out.full.items())}
    return out


def _reach() -> list[tuple[int, int]]:
    """Differences in length and in letters up to m that EDITS edits can make."""
    one = {(0, 0), (0, 1), (0, -1), (1, 0), (1, 1), (-1, 0), (-1, -1)}
    out = {(0, 0)}
    for _ in range(EDITS):
        out = {(a + c, b + d) for a, b in out for c, d in one}
    return sorted(out)


def cells_of(word: Column, by: int, reach: bool) -> Column:
    """The cells a word visits, or the one it lies in: by nothing, by length, or by length and letters up to m."""
    size, low = F.length(word), F.length(F.regexp_replace(word, "[^a-m]", ""))
    steps = _reach() if reach and by else [(0, 0)]
    if by < 2:
        steps = sorted({(a, 0) for a, _ in steps})
    clip = lambda c: F.greatest(F.lit(0), F.least(c, F.lit(_LONGEST)))
    cell = lambda a, b: (clip(size + a) * 64 + (clip(low + b) if by > 1 else 0)) if by else F.lit(0)
    return F.array_distinct(F.array(*[cell(a, b).cast("int") for a, b in steps]))


def _walk(asked: pa.Table, known: pa.Table) -> pa.Table:
    words = sorted(set(asked["w"].to_pylist()))
    found = Trie(sorted(set(known["n"].to_pylist())), EDITS).neighbours(words)
    rows = [(w, n, d) for w, near in found.items() for n, d in near.items()]
    cols = list(zip(*rows)) if rows else [[]] * 3
    return pa.table([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.int32()))], ["w", "n", "d"])


def near_words(asked: DataFrame, known: DataFrame, by: int | None = None, block: int = BLOCK) -> DataFrame:
    """(w, n, d): for each distinct asked word (w) the distinct known words (n) within the edit bound. `by` and `block` change the way, not the rows."""
    total = known.count()
    by = by if by is not None else 0 if total <= ONE_CELL else 1 if total <= BY_LENGTH else 2
    left = asked.select("w", F.explode(cells_of(F.col("w"), by, True)).alias("cell"))
    right = known.select("n", F.explode(cells_of(F.col("n"), by, False)).alias("cell"))
    sizes = left.groupBy("cell").agg(F.count("*").alias("a")).join(right.groupBy("cell").agg(F.count("*").alias("k")), "cell")
    blocks = F.broadcast(sizes.select("cell", F.ceil(F.col("a") / F.greatest("k", F.lit(block))).cast("int").alias("blocks")))  # 4 096 cells at most
    left = left.join(blocks, "cell").select("w", "cell", F.pmod(F.xxhash64("w"), "blocks").cast("int").alias("block"))
    right = right.join(blocks, "cell").select("n", "cell", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    tasks = max(2 * asked.sparkSession.sparkContext.defaultParallelism, int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    left, right = left.repartition(tasks, "cell", "block"), right.repartition(tasks, "cell", "block")  # blocks are few and costly: not to be coalesced into one task
    return left.groupBy("cell", "block").cogroup(right.groupBy("cell", "block")).applyInArrow(_walk, "w string, n string, d int")


def _split(with_parts: bool):
    """mapInArrow function that adds the words of the first column's texts, and ways to read them with two neighbours put together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            split = [name_words(t) for t in b.column(0).to_pylist()]
            if with_parts:
                ways = [[w, *([w[:i] + [w[i] + w[i + 1]] + w[i + 2 :] for i in range(len(w) - 1)] if len(w) <= JOINED else [])] for w in split]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ways, pa.list_(pa.list_(pa.string())))], [b.schema.names[0], "ways"])
            else:
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(split, pa.list_(pa.string()))], [*b.schema.names, "words"])

    return run


def name_table(names: DataFrame) -> DataFrame:
    """(no, qid, words, rare): every different name of an entity; rare are the words that are hardly more frequent than its rarest."""
    words = names.select("name", "qid").mapInArrow(_split(False), "name string, qid string, words array<string>").where("size(words) > 0").select("qid", "words").distinct()
    rows = scratch.keep(words.withColumn("no", F.monotonically_increasing_id()), "names")
    often = rows.select(F.explode(F.array_distinct("words")).alias("w"), F.lit(1).alias("one")).groupBy("w").agg(F.count("*").alias("often"))
    each = rows.select("no", F.explode(F.array_distinct("words")).alias("w")).join(often, "w")
    least = each.groupBy("no").agg(F.min("often").alias("least"))
    rare = each.join(least, "no").where("often <= 2 * least").groupBy("no").agg(F.array_sort(F.collect_list("w")).alias("rare"))
    return rows.join(rare, "no").select("no", "qid", "words", "rare")


def _keys_of_names(habits: Habits):
    """mapInArrow function to (key, no, qid, words, rare): the keys a name is found by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, keys = [], []
            for i, (words, rare) in enumerate(zip(b.column("words").to_pylist(), b.column("rare").to_pylist())):
                own = {"w" + w for w in rare} | {"c" + w[:CUT] for w in rare if len(w) > CUT}
                for letters in (words, [w for w in words if w not in habits.added]):
                    if len(letters) >= ACRONYM:
                        own.add("a" + "".join(w[0] for w in letters))
                at += [i] * len(own)
                keys += sorted(own)
            rows = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), *(b.column(c).take(rows) for c in ("no", "qid", "words", "rare"))], ["key", "no", "qid", "words", "rare"])

    return run


def _keys_of_spellings(habits: Habits):
    """mapInArrow function to (spelling, key): the keys under which a spelling looks for names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spellings, keys = [], []
            for s, ways, near in zip(b.column("spelling").to_pylist(), b.column("ways").to_pylist(), b.column("near").to_pylist()):
                own = set()
                for x in near or ():
                    own.add("w" + x["n"])
                    own.update("w" + f for f in habits.full.get(x["n"], ()))
                own.update("c" + w[:CUT] for way in ways for w in way if len(w) >= CUT)
                letters = "".join(ways[0])
                if ACRONYM <= len(letters) <= 8 and (len(ways[0]) == 1 or all(len(w) == 1 for w in ways[0])):
                    own.add("a" + letters)
                spellings += [s] * len(own)
                keys += own
            yield pa.RecordBatch.from_arrays([pa.array(spellings, pa.string()), pa.array(keys, pa.string())], ["spelling", "key"])

    return run


class Reader:
    """Readings of spellings as names."""

    def __init__(self, habits: Habits):
        self.habits, self.price = habits, habits.costs()

    def word(self, m: str, n: str, rare: set[str], near: dict[tuple[str, str], int]) -> tuple[float, int] | None:
        """(cost, edits) of reading m as n."""
        price = self.price
        if m == n:
            return 0.0, 0
        if len(m) == 1:
            return (price["initial"], 0) if n[0] == m else None
        ways = []
        if n in self.habits.full.get(m, ()):
            ways.append((price["short"], 0))
        d = near.get((m, n))
        if d is not None and 0 < d <= edit_limit(m, n):
            ways.append((price[f"edit{d}"], d))
        if n in rare and CUT <= len(m) < len(n) and n.startswith(m):
            ways.append((price["cut"], 0))
        if len(m) >= 3:
            ways += [(price["short"] + price["edit1"], 1) for short in self.shorts.get(n, ()) if near.get((m, short)) == 1]
        return min(ways) if ways else None

    @property
    def shorts(self) -> dict[str, list[str]]:
        """Known word to its short forms."""
        if not hasattr(self, "_shorts"):
            self._shorts = defaultdict(list)
            for short, fulls in self.habits.full.items():
                for f in fulls:
                    self._shorts[f].append(short)
        return self._shorts

    def name(self, words: list[str], name: list[str], rare: set[str], near: dict[tuple[str, str], int]) -> float | None:
        """Least cost of assigning every word of a spelling to a different word of a name.

        States are the words of the name taken so far, counted for equal words,
        with edits and spare initials; of each only the cheapest is kept, so
        repeated words do not multiply readings.
        """
        kinds = Counter(name)
        order = list(kinds)
        states = {((0,) * len(order), 0, 0): 0.0}
        for m in words:
            table = [self.word(m, n, rare, near) for n in order]
            new: dict[tuple, float] = {}

            def put(taken: tuple, e: int, spare: int, cost: float) -> None:
                if e <= EDITS and cost < new.get((taken, e, spare), 1e9):
                    new[taken, e, spare] = cost

            for (taken, e, spare), cost in states.items():
                for j, got in enumerate(table):
                    if got is not None and taken[j] < kinds[order[j]]:
                        put((*taken[:j], taken[j] + 1, *taken[j + 1 :]), e + got[1], spare, cost + got[0])
                if m in self.habits.added:
                    put(taken, e, spare, cost + self.price["added"])
                elif len(m) == 1 and not spare and len(words) > 2 and len(name) == 2:
                    put(taken, e, 1, cost + self.price["initial"])  # a middle initial
            states = new
            if not states:
                return None
        best = None
        for (taken, _, _), cost in states.items():
            more = self.missing(order, kinds, taken, rare)
            if more is not None and (best is None or cost + more < best):
                best = cost + more
        return best

    def missing(self, order: list[str], kinds: Counter, taken: tuple, rare: set[str]) -> float | None:
        """Cost of the words of the name that the spelling lacks; None where it cannot lack them, or lacks all rare ones."""
        if not any(k for n, k in zip(order, taken) if n in rare):
            return None
        cost, out = 0.0, 0
        for n, k in zip(order, taken):
            for _ in range(kinds[n] - k):
                if n in self.habits.added:
                    cost += self.price["added"]
                elif n in self.habits.left and n not in rare and not out:
                    cost, out = cost + self.price["left"], 1
                else:
                    return None
        return cost

    def read(self, ways: list[list[str]], name: list[str], rare: list[str], near: dict[tuple[str, str], int]) -> float | None:
        """Cost of the cheapest reading of a spelling, as it stands, with two neighbours put together, or as initials."""
        costs = []
        own = set(rare)
        for k, words in enumerate(ways):
            c = self.name(words, name, own, near) if words else None
            if c is not None:
                costs.append(c + self.price["edit1"] * (k > 0))
        letters = "".join(ways[0])
        if len(ways[0]) == 1 or all(len(w) == 1 for w in ways[0]):
            for of in (name, [w for w in name if w not in self.habits.added]):
                if len(of) >= ACRONYM and letters == "".join(w[0] for w in of):
                    costs.append(self.price["acronym"])
        return min(costs) if costs else None


def _read(habits: Habits):
    """mapInArrow function from candidates to (spelling, qid, cost) of those that can be read so."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(habits)
        for b in batches:
            out = []
            cols = (b.column(c).to_pylist() for c in ("spelling", "ways", "near", "qid", "words", "rare"))
            for s, ways, near, q, words, rare in zip(*cols):
                c = reader.read(ways, words, rare, {(x["w"], x["n"]): x["d"] for x in near or ()})
                if c is not None:
                    out.append((s, q, c))
            cols = list(zip(*out)) if out else [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.float64()))], ["spelling", "qid", "cost"])

    return run


def match_spellings(spellings: DataFrame, names: DataFrame, habits: Habits, by: int | None = None, block: int = BLOCK) -> DataFrame:
    """(spelling, qid, cost): for each of the distinct spellings the entities of the cheapest reading."""
    spark = spellings.sparkSession
    table = scratch.keep(name_table(names), "nametable")
    asked = scratch.keep(scratch.spread(spellings.select("spelling")).mapInArrow(_split(True), "spelling string, ways array<array<string>>").where("size(ways[0]) > 0"), "asked")
    words = asked.select("spelling", F.explode(F.array_distinct(F.flatten("ways"))).alias("w")).where("length(w) > 1")
    shorts = spark.createDataFrame([(w,) for w in habits.full], "n string")  # MAX_HABITS at most
    known = table.select(F.explode("words").alias("n")).union(shorts).distinct()
    near = scratch.keep(near_words(words.select("w").distinct(), known, by, block).groupBy("w").agg(F.collect_list(F.struct("w", "n", "d")).alias("near")), "near")
    lists = words.join(near, "w").groupBy("spelling").agg(F.flatten(F.collect_list("near")).alias("near"))
    asked = scratch.keep(asked.join(lists, "spelling", "left"), "looked")
    keys = asked.mapInArrow(_keys_of_spellings(habits), "spelling string, key string")
    index = table.mapInArrow(_keys_of_names(habits), "key string, no bigint, qid string, words array<string>, rare array<string>")
    found = keys.join(index, "key").select("spelling", "no", "qid", "words", "rare").distinct()
    read = found.join(asked, "spelling").mapInArrow(_read(habits), "spelling string, qid string, cost double")
    read = scratch.keep(read.groupBy("spelling", "qid").agg(F.min("cost").alias("cost")), "readings")
    least = read.groupBy("spelling").agg(F.min("cost").alias("least"))
    return read.join(least, "spelling").where(F.col("cost") <= F.col("least") + 1e-9).drop("least")


def link_variants(rows: DataFrame, id_col: str, name_col: str, group_col: str, names: DataFrame, known: DataFrame, habits: Habits) -> DataFrame:
    """(id, qid, cost) of the rows whose name is a spelling of a known entity.

    names: (qid, name) of the known entities. known: (group, qid) of rows that
    are resolved already. Where a spelling fits several entities equally, the
    one most often resolved or read with certainty in the row's group wins,
    then the one resolved most often anywhere, then the lesser qid.

    Null and blank names and names without letters give no row; rows of one id
    each give one; a row without group is decided by the overall counts. Other
    columns are ignored. Empty tables give an empty result.
    """
    rows = rows.select(F.col(id_col).alias("id"), F.col(group_col).alias("grp"), spelling_of(F.col(name_col)).alias("spelling")).where("spelling is not null")
    spellings = scratch.keep(rows.select("spelling").distinct(), "spellings")
    fits = scratch.keep(match_spellings(spellings, names, habits), "fits")
    fits = fits.join(fits.groupBy("spelling").agg(F.count("*").alias("k")), "spelling")
    read = scratch.keep(rows.join(fits, "spelling").select("id", "grp", "qid", "cost", "k"), "read")
    sure, doubt = read.where("k = 1"), read.where("k > 1")
    wanted = doubt.select("qid").distinct()
    seen = known.select(F.col("grp"), "qid").join(wanted, "qid", "left_semi")
    overall = seen.groupBy("qid").agg(F.count("*").alias("anywhere"))
    local = seen.union(sure.select("grp", "qid").join(wanted, "qid", "left_semi")).where("grp is not null").groupBy("grp", "qid").agg(F.count("*").alias("here"))
    ranked = doubt.join(local, ["grp", "qid"], "left").join(overall, "qid", "left")
    order = F.struct(-F.coalesce("here", F.lit(0)), -F.coalesce("anywhere", F.lit(0)), "qid")
    chosen = ranked.groupBy("id").agg(F.min(F.struct(order.alias("o"), "qid", "cost")).alias("b")).select("id", "b.qid", "b.cost")
    return sure.select("id", "qid", "cost").union(chosen)


def held_out(linked: DataFrame, names: DataFrame) -> DataFrame:
    """(form, n_rows, n_right, n_wrong, n_missed) of resolved rows of half of the entities by habits learned from the other half, plain names and variants apart.

    linked: (id, grp, spelling, qid) of resolved rows of known entities. The
    entities are halved by a hash. Rows are read as if they were unresolved;
    ties are decided by the other rows of the half that taught.
    """
    linked = linked.where("spelling is not null").join(names.select("qid").distinct(), "qid", "left_semi")
    half = F.pmod(F.xxhash64("qid", F.lit(3)), F.lit(2))
    taught, asked = linked.where(half == 0), linked.where(half == 1)
    habits = learn(taught.select("spelling", "qid"), names)
    found = link_variants(asked, "id", "spelling", "grp", names, taught.select("grp", "qid"), habits).select("id", F.col("qid").alias("got"))
    plain = names.select(F.col("name").alias("spelling"), "qid", F.lit("plain").alias("form"))
    rows = asked.join(plain, ["spelling", "qid"], "left").join(found, "id", "left")
    count = lambda c: F.count(F.when(c, 1))
    right = F.col("got") == F.col("qid")
    return rows.groupBy(F.coalesce("form", F.lit("variant")).alias("form")).agg(F.count("*").alias("n_rows"), count(right).alias("n_right"), count(~right).alias("n_wrong"), count(F.col("got").isNull()).alias("n_missed"))
