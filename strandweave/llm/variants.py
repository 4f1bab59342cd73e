"""Spelling variants: words at distance one, found by forward and backward minimal automata.

Words at distance one agree exactly in the first or in the second half, for the error lies in one half only. A forward automaton of the dictionary reads the first half of a word exactly and completes
the second with one error; a backward automaton of the reversed dictionary does the same for the other half. Both are
minimal acyclic automata with perfect-hash numbers (a word's number is its rank), so a completion is a number. What
both directions find is deduplicated.

Scale. The dictionary is never in one place. A word of L letters asks for words that share its first L div 2 letters, or its
last; the dictionary is dealt by these halves, for the three lengths that may ask, and a task builds automata of some ten
thousand words at a time. A group of more than MOST rows is dealt anew by the halves of the part where the
error may lie, again and again until it is small or that part is one letter: all words of such a group differ in one place, so the
alphabet bounds it. Counts are summed before their shuffle. Nothing is collected but whether a large group is left.

Null texts have no words; a null doc_id counts as empty in h. Repeated rows count again. Words of any length are taken;
completions of long words remember where they have been, so runs of one letter stay linear. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandweave.llm.common import documents, whole_groups, written

CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RUNS = "([a-zÀ-ÿ]+)"
SHORTEST, LEAST, FACTOR, EVERY = 6, 5, 5, 199
MOST, CHUNK = 10_000, 20_000


class Automaton:
    """Minimal acyclic automaton of sorted, distinct words; a word's number is its place among them."""

    def __init__(self, words: list[str]):
        self.edges: list[dict[str, tuple[int, int]]] = []  # letter -> (state, words that come before)
        self.final: list[bool] = []
        self.size: list[int] = []  # words from here
        self.register: dict[tuple, int] = {}
        path: list[tuple[list[bool], dict[str, int]]] = [([False], {})]
        last = ""
        for w in words:
            same = 0
            for x, y in zip(last, w, strict=False):
                if x != y:
                    break
                same += 1
            self._close(path, last, same)
            path += [([False], {}) for _ in w[same:]]
            path[-1][0][0] = True
            last = w
        self._close(path, last, 0)
        self.start = self._state(path[0])

    def _close(self, path: list, word: str, upto: int) -> None:
        while len(path) > upto + 1:
            node = path.pop()
            path[-1][1][word[len(path) - 1]] = self._state(node)

    def _state(self, node: tuple[list[bool], dict[str, int]]) -> int:
        final, to = node[0][0], node[1]
        key = (final, tuple(to.items()))
        got = self.register.get(key)
        if got is None:
            got = self.register[key] = len(self.edges)
            n, edges = int(final), {}
            for c, s in to.items():
                edges[c] = (s, n)
                n += self.size[s]
            self.edges.append(edges)
            self.final.append(final)
            self.size.append(n)
        return got

    def _finish(self, s: int, word: str, at: int, seen: dict[tuple[int, int], int]) -> int:
        """What the rest of the word adds to its number when read exactly from s; -1: not accepted."""
        steps, total = [], 0
        while True:
            known = seen.get((s, at))
            if known is not None:
                end = known
                break
            steps.append((s, at, total))
            if at == len(word):
                end = 0 if self.final[s] else -1
                break
            edge = self.edges[s].get(word[at])
            if edge is None:
                end = -1
                break
            s, at, total = edge[0], at + 1, total + edge[1]
        if len(steps) > 8:
            for x, y, before in steps:
                seen[(x, y)] = end if end < 0 else total - before + end
        return end if end < 0 else total + end

    def completions(self, word: str, half: int) -> set[int]:
        """Numbers of the words that begin with word[:half] and go on as word[half:] with exactly one error."""
        s, number = self.start, 0
        for c in word[:half]:
            edge = self.edges[s].get(c)
            if edge is None:
                return set()
            s, number = edge[0], number + edge[1]
        found: set[int] = set()
        seen: dict[tuple[int, int], int] = {}
        for at in range(half, len(word) + 1):
            c = word[at] if at < len(word) else None
            for x, (t, before) in self.edges[s].items():
                for go in (at, at + 1) if c is not None and x != c else (at,):
                    end = self._finish(t, word, go, seen)
                    if end >= 0:
                        found.add(number + before + end)
            if c is None:
                break
            end = self._finish(s, word, at + 1, seen)
            if end >= 0:
                found.add(number + end)
            edge = self.edges[s].get(c)
            if edge is None:
                break
            s, number = edge[0], number + edge[1]
        return found


def lexicon(docs: DataFrame, shortest: int = SHORTEST, least: int = LEAST, every: int = EVERY) -> DataFrame:
    """word, n: the runs of letters of whole texts, a few of which lose a letter as their check sum says."""
    run = F.col("run")
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all(F.translate("text", CAPITALS, SMALL), F.lit(RUNS), F.lit(1))).alias("run")).where(F.length(run) >= shortest)
    h = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = F.col("h") % F.length(run)
    cut = F.concat(F.substring(run, F.lit(1), at.cast("int")), F.substring(run, (at + 2).cast("int"), F.length(run)))
    words = runs.withColumn("h", h).select(F.when(F.col("h") % every == 0, cut).otherwise(run).alias("word"))
    return words.where(F.length("word") >= shortest).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def group_of(lo: Column, hi: Column) -> Column:
    """Words for askers of `asked` letters whose error lies in [lo, hi): what stands before and after."""
    after = F.col("asked") - hi
    tail = F.when(after > 0, F.substring("word", (F.length("word") - after + 1).cast("int"), after.cast("int"))).otherwise("")
    return F.xxhash64("asked", lo, hi, F.substring("word", F.lit(1), lo.cast("int")), tail)


def dealt(words: DataFrame, shortest: int, most: int) -> DataFrame:
    """group, word, n, asks, backward: every word for the askers of its own and the two neighbouring lengths."""
    asked, half = F.col("asked"), F.floor(F.col("asked") / 2).cast("int")
    rows = words.withColumn("asked", F.explode(F.sequence(F.length("word") - 1, F.length("word") + 1))).where(asked >= shortest)
    rows = rows.withColumn("part", F.explode(F.array(F.struct(F.lit(0).alias("lo"), half.alias("hi")), F.struct(half.alias("lo"), asked.alias("hi")))))
    rows = rows.select("word", "n", "asked", "part.lo", "part.hi", (F.col("part.hi") == half).alias("backward")).withColumn("group", group_of(F.col("lo"), F.col("hi")))
    done = None
    while True:
        rows = written(rows, "op12-dealt")
        hot = written(rows.groupBy("group").agg(F.count("*").alias("k"), F.max(F.col("hi") - F.col("lo")).alias("wide")).where((F.col("k") > most) & (F.col("wide") > 1)).select("group"), "op12-hot")
        if hot.isEmpty():
            rows = rows if done is None else done.unionByName(rows)
            return rows.select("group", "word", "n", (F.length("word") == F.col("asked")).alias("asks"), "backward")
        cool = rows.join(hot, "group", "left_anti")
        done = cool if done is None else done.unionByName(cool)
        mid = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
        rows = rows.join(hot, "group", "left_semi").withColumn("part", F.explode(F.array(F.struct(F.col("lo"), mid.alias("hi")), F.struct(mid.alias("lo"), F.col("hi")))))
        rows = rows.select("word", "n", "asked", "part.lo", "part.hi", "backward").where("lo < hi").withColumn("group", group_of(F.col("lo"), F.col("hi")))


def near_words(words: DataFrame, shortest: int = SHORTEST, most: int = MOST) -> DataFrame:
    """word, n, near, near_n: all ordered pairs of distinct words (word, n) at distance one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in whole_groups(batches, "group", CHUNK):
            rows = list(zip(*(b.column(c).to_pylist() for c in ("word", "n", "asks", "backward")), strict=True))
            found: set[tuple] = set()
            for backward in (False, True):
                number = {w[::-1] if backward else w: n for w, n, _, back in rows if back == backward}
                order = sorted(number)
                index = Automaton(order)
                for w in {w for w, _, asks, back in rows if asks and back == backward}:
                    x, half = (w[::-1], len(w) - len(w) // 2) if backward else (w, len(w) // 2)
                    for k in index.completions(x, half):
                        y = order[k]
                        found.add((w, number[x], y[::-1] if backward else y, number[y]))
            cols = list(zip(*found, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.int64())], names=["word", "n", "near", "near_n"])

    return dealt(words, shortest, most).repartition("group").sortWithinPartitions("group").mapInArrow(run, "word string, n long, near string, near_n long").distinct()


def spelling_variants(docs: DataFrame, shortest: int = SHORTEST, least: int = LEAST, factor: int = FACTOR, every: int = EVERY, most: int = MOST) -> DataFrame:
    """word, n, form, root, n_near, form_n of every word."""
    words = written(lexicon(docs, shortest, least, every), "op12-words")
    first = F.min(F.struct((-F.col("near_n")).alias("k"), "near"))
    best = near_words(words, shortest, most).groupBy("word").agg(F.count("*").alias("n_near"), first.alias("b"))
    rows = words.join(best, "word", "left").withColumn("form", F.when(-F.col("b.k") >= factor * F.col("n"), F.col("b.near")))
    rows = written(rows.select("word", "n", "form", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(F.col("form").isNotNull(), -F.col("b.k")).alias("form_n")), "op12-forms")
    roots = rows.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:  # each round doubles how far a word looks; forms grow by the factor, so there are few
        roots = written(roots, "op12-roots")
        ahead = roots.join(roots.select(F.col("word").alias("root"), F.col("root").alias("next")), "root")
        if ahead.isEmpty():
            break
        roots = roots.join(ahead.select("word", "next"), "word", "left").select("word", F.coalesce("next", "root").alias("root"))
    return rows.join(roots, "word", "left").select("word", "n", "form", F.coalesce("root", "word").alias("root"), "n_near", "form_n")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(documents(spark, sf_dir))


OP12_SQL = """
WITH RECURSIVE crc AS (
    SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) r(i)
), runs AS (
    SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents
), counted AS (
    SELECT doc_id, run, count(*) AS k FROM runs WHERE length(run) >= 6 GROUP BY ALL
), hashed AS (
    SELECT run, k, xor(4294967295, list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || run, ''),
        lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT] ELSE [(192 + unicode(x) // 64)::BIGINT, (128 + unicode(x) % 64)::BIGINT] END))),
        lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)]))) AS h
    FROM counted, crc
), words AS (
    SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, sum(k)::BIGINT AS n
    FROM hashed GROUP BY 1 HAVING length(word) >= 6 AND n >= 5
), holes AS (
    SELECT word, n, unnest(range(length(word))) AS k, word[:k] || word[k + 2:] AS rest FROM words
), pairs AS (
    SELECT a.word, a.n, b.word AS near, b.n AS near_n FROM holes a JOIN holes b ON a.k = b.k AND a.rest = b.rest AND a.word <> b.word
    UNION SELECT h.word, h.n, w.word, w.n FROM holes h JOIN words w ON h.rest = w.word
    UNION SELECT w.word, w.n, h.word, h.n FROM holes h JOIN words w ON h.rest = w.word
), best AS (
    SELECT word, count(*) AS n_near, min({'k': -near_n, 'near': near}) AS b FROM pairs GROUP BY word
), forms AS (
    SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN -b.k >= 5 * n THEN b.near END AS form, CASE WHEN -b.k >= 5 * n THEN -b.k END AS form_n FROM words w LEFT JOIN best USING (word)
), walk AS (
    SELECT word, word AS here, 0 AS step FROM forms
    UNION ALL SELECT w.word, f.form, step + 1 FROM walk w JOIN forms f ON w.here = f.word WHERE f.form IS NOT NULL
), roots AS (
    SELECT word, max_by(here, step) AS root FROM walk GROUP BY word
)
SELECT word, n, form, root, n_near, form_n::BIGINT AS form_n FROM forms JOIN roots USING (word)
"""
