"""Spelling variants: words one edit apart, and the common form that a rare one stands for.

The words form a trie. At each node the child with the most words below it is heavy, all others, and a word that ends
there, are light; a word lies in at most log2(words) light subtrees, as each halves what is left. Light subtrees are
merged into what lies beside them, with the character at the node replaced or skipped:

* replaced by a wildcard: the words that fall together, the heavy child's word among them, differ in that character;
* skipped: a light word without the character may be a word below the node;
* before it the heavy character: a light word with that may be a word below the heavy child, which skips it.

Terminals that coincide are pairs, and each pair is found once: two words that differ by a replaced character part at
one node, where one of them at least is light; of two that differ by a skipped one, the last of a run of equal
characters, either the longer one is light there, or the skipped character is the heavy one and the other is light.

The trie is never built in one place. Its nodes are 64-bit hashes of prefixes, its sizes a grouped count, its light
edges a join, and a merge is a join of changed words with the words. Prefixes that collide only make more edges light,
and what is looked up is spelled out, so that a collision costs work and no result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved, text_or_empty

#: A run of letters, as a Java regular expression; one occurrence in SLIPS loses a character.
LETTERS, SLIPS = "A-Za-z\\u00C0-\\u00FF", 97
LEAST_CHARS, LEAST_N = 5, 3
#: Nodes with more than a part in HOT_PARTS of all words are broadcast, if they are MAX_BROADCAST at most. There are at
#: most HOT_PARTS of them a depth.
HOT_PARTS, MAX_BROADCAST = 1000, 200_000
#: Characters of words whose prefixes are listed at a time; the end of a word as an edge, and any one character.
TOGETHER, END, ANY = 1 << 20, "", "*"

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def slipped(doc_id: Column, run: Column) -> Column:
    """The run without the character that its checksum names, if 97 divides that."""
    h = F.crc32(F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("")), run).cast("binary"))
    at = F.pmod(h, F.length(run).cast("long")).cast("int")
    rest = F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))
    return F.when(h % SLIPS == 0, rest).otherwise(run)


def words(docs: DataFrame, least_chars: int = LEAST_CHARS, least_n: int = LEAST_N) -> DataFrame:
    """word and n: the distinct words of docs(doc_id, text) of `least_chars` characters or more that occur `least_n` times or more.

    Words are runs of letters with A-Z lower-cased and some slips of the pen, as ``slipped`` draws them from doc_id and
    word. Null and empty texts have none; a null doc_id draws as an empty one; repeated rows count again; texts and runs
    may be of any length; an empty table gives no words; other columns are ignored.
    """
    runs = F.explode(F.split(text_or_empty(F.col("text")), f"[^{LETTERS}]+"))
    rows = docs.select("doc_id", runs.alias("run")).filter("run != ''")
    low = F.when(F.col("run").rlike("[A-Z]"), F.translate("run", _UPPER, _LOWER)).otherwise(F.col("run"))
    found = rows.select("doc_id", low.alias("run")).select(slipped(F.col("doc_id"), F.col("run")).alias("word"))
    return found.filter(F.length("word") >= least_chars).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least_n)


_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * _MIX[1]
    x = (x ^ x >> np.uint64(27)) * _MIX[2]
    return x ^ x >> np.uint64(31)


def _steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, depth, node, edge) for each character of the words, and for their ends: node is the hash of what is before.

    A prefix's hash is a sum of its characters, each mixed and times a power of an odd number for its place, so that all
    of them come from one running sum.
    """
    for batch in batches:
        lengths = pc.utf8_length(batch.column(1)).to_numpy().astype(np.int64)
        cuts = np.flatnonzero(np.diff(np.cumsum(lengths) // TOGETHER)) + 1
        for at, to in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
            some, n = batch.column(1)[at:to], lengths[at:to]
            data = "".join(some.to_pylist()).encode("utf-32-le")
            codes = np.frombuffer(data, dtype="<u4").astype(np.uint64)
            begins = np.cumsum(n) - n
            place = np.arange(len(codes)) - np.repeat(begins, n)
            powers = np.cumprod(np.full(int(n.max(initial=0)), _MIX[0]))
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mixed(codes + _MIX[1]) * powers[place])])
            # one step more a word: its end
            which, depth = np.repeat(np.arange(to - at), n + 1), np.arange(len(codes) + to - at) - np.repeat(begins + np.arange(to - at), n + 1)
            node = _mixed(sums[begins[which] + depth] - sums[begins[which]] + depth.astype(np.uint64) * _MIX[2])
            edge = np.insert(np.frombuffer(data, dtype="<U1"), np.cumsum(n), END)
            columns = [pa.array(batch.column(0).to_numpy()[at:to][which]), pa.array(depth.astype(np.int32)), pa.array(node.view(np.int64)), pa.array(edge)]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "depth", "node", "edge"])


def light_edges(vocabulary: DataFrame) -> DataFrame:
    """id and edges, an array of (depth, heavy): where a word of vocabulary(id, word) leaves the heavy path, and its character."""
    n = vocabulary.count()
    steps = saved(vocabulary.select("id", "word").mapInArrow(_steps, "id long, depth int, node long, edge string"), "spelling-steps")
    children = steps.groupBy("node", "edge").agg(F.count("*").alias("below"))
    heavy = F.max_by("edge", F.when(F.col("edge") != END, F.struct("below", "edge")))  # never a word's end
    nodes = children.groupBy("node").agg(F.count("*").alias("children"), heavy.alias("heavy"), F.sum("below").alias("below"))
    forks = saved(nodes.filter("children > 1").select("node", "heavy", "below"), "spelling-forks")
    hot = forks.filter(F.col("below") > n // HOT_PARTS).select("node", "heavy")
    light = lambda at: at.filter(F.col("edge") != F.col("heavy")).select("id", "depth", "heavy")
    if hot.count() > MAX_BROADCAST:
        found = light(steps.join(forks, "node"))
    else:
        few = forks.filter(F.col("below") <= n // HOT_PARTS).select("node", "heavy")
        rest = steps.join(F.broadcast(hot), "node", "left_anti")
        found = light(steps.join(F.broadcast(hot), "node")).union(light(rest.join(few, "node")))
    return found.groupBy("id").agg(F.collect_list(F.struct("depth", "heavy")).alias("edges"))  # log2(n) at most


def neighbours(vocabulary: DataFrame) -> DataFrame:
    """(word, n_near, best) of the words of vocabulary(id, word, n) that have words one edit away: how many, and the best
    of them, a struct of minus n and the word: that of the largest n, of equal ones the first."""
    edges = light_edges(vocabulary).select(F.col("id").alias("_id"), "edges")
    at = vocabulary.join(edges, F.col("id") == F.col("_id")).select("word", "n", F.inline("edges"))
    before, mine, after = F.substring("word", F.lit(1), F.col("depth")), F.substring("word", F.col("depth") + 1, F.lit(1)), F.substring("word", F.col("depth") + 2, F.length("word"))
    at = at.select("word", "n", "heavy", before.alias("before"), mine.alias("mine"), after.alias("after"))
    entry = lambda word, n: F.struct((-F.col(n)).alias("minus"), F.col(word).alias("word"))
    there = vocabulary.select(F.col("word").alias("other"), F.col("n").alias("other_n"))

    # one character replaced: as many words as the alphabet has characters meet at most
    class_of = at.filter(F.col("mine") != END).groupBy(F.concat("before", F.lit(ANY), "after").alias("pattern"))
    classes = class_of.agg(F.collect_list(entry("word", "n")).alias("members"), F.first(F.concat("before", "heavy", "after")).alias("target"))
    whole = classes.join(there, F.col("target") == F.col("other"), "left")
    members = F.array_sort(F.concat("members", F.when(F.col("other").isNotNull(), F.array(entry("other", "other_n"))).otherwise(F.slice("members", 1, 0))))
    met = whole.select(members.alias("members")).filter(F.size("members") > 1)
    met = met.select(F.explode("members").alias("m"), F.size("members").alias("k"), F.get("members", F.lit(0)).alias("one"), F.get("members", F.lit(1)).alias("two"))
    replaced = met.select(F.col("m.word").alias("word"), (F.col("k") - 1).cast("long").alias("k"), F.when(F.col("m") == F.col("one"), F.col("two")).otherwise(F.col("one")).alias("best"))

    # one character skipped: the word's own, the last of a run, or the heavy one before it
    without = F.when((F.col("mine") != END) & ~F.startswith("after", "mine"), F.concat("before", "after"))
    targets = F.explode(F.array_compact(F.array(without, F.concat("before", "heavy", "mine", "after"))))
    pairs = at.select("word", "n", targets.alias("target")).join(there, F.col("target") == F.col("other"))
    both = F.inline(F.array(F.struct(F.col("word").alias("word"), entry("other", "other_n").alias("best")), F.struct(F.col("other").alias("word"), entry("word", "n").alias("best"))))
    skipped = pairs.select(both).select("word", F.lit(1).cast("long").alias("k"), "best")
    return replaced.union(skipped).groupBy("word").agg(F.sum("k").alias("n_near"), F.min("best").alias("best"))


def spelling_forms(found: DataFrame, ratio: int = 2) -> DataFrame:
    """word, form, root, n, n_near and form_n of each word of found(word, n), whose words are distinct.

    n_near counts words one inserted, deleted or replaced character away. form is the one of them with the largest n, of
    equal ones the first in the order of code points, and form_n its n, if that is `ratio` times the word's n or more;
    else both are null. root is where forms of forms end, the word itself if it has none: n grows by the ratio at each
    step, so that there are log(largest n) steps at most. Words have any length and characters but "*"; a null word
    is left out; an empty table gives no rows.
    """
    rows = found.filter("word is not null").select("word", F.col("n").cast("long").alias("n"))
    vocabulary = saved(rows.withColumn("id", F.monotonically_increasing_id()), "spelling-words")
    near = neighbours(vocabulary).select(F.col("word").alias("_word"), "n_near", "best")
    joined = vocabulary.join(near, F.col("word") == F.col("_word"), "left")
    known = -F.col("best.minus") >= ratio * F.col("n")
    columns = [F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(known, F.col("best.word")).alias("form"), F.when(known, -F.col("best.minus")).alias("form_n")]
    forms = saved(joined.select("word", "n", *columns), "spelling-forms")
    order = ["word", "form", "root", "n", "n_near", "form_n"]
    level = forms.filter("form is null").withColumn("root", F.col("word")).select(*order)
    out, rest = level, forms.filter("form is not null")
    while True:
        above = level.select(F.col("word").alias("_form"), "root")
        level = saved(rest.join(above, F.col("form") == F.col("_form")).select(*order), "spelling-roots")
        if level.isEmpty():
            return out
        out = out.union(level)
