"""Token ids in a binary format of checksummed, range-coded blocks, written by Spark and read back in parallel.

A token file is a table of segments in ascending document order. A segment's payload is, all numbers little-endian:
"TIDS", u32 documents, u32 blocks, then i64 doc_id, u8 null and u32 ids of each document, then u32 ids, u32 bytes and
u32 CRC-32 of each block, then the blocks. Blocks hold the ids of the segment's documents one after another, and each
can be decoded alone. Segments are rows of a Parquet table, so that writing survives lost executors and any storage that
Spark knows will do.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import saved, text_or_empty
from .id_coder import BLOCK, IDS, decoded, encoded

END_ID = 1
#: Ids after which a segment ends, with the document that reaches it.
SEGMENT_IDS = 8_000_000
#: How a segment's documents and blocks are listed.
_DOC, _BLOCK = np.dtype([("id", "<i8"), ("null", "u1"), ("n", "<u4")]), np.dtype([("n", "<u4"), ("bytes", "<u4"), ("crc", "<u4")])
#: How a tokenizer that lower-cases, drops white space and never joins what white space parts is spelled in its file.
_BY_WORDS = (
    [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}],
    {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
)
#: Between a letter or digit and a sign such a tokenizer always cuts, but for the apostrophe; a cut there makes fewer words.
_SEAM = r"([a-z0-9])([!-&(-/:-@\[-`{-~])"
#: The rest of such a tokenizer: bytes of a word as characters, and a mark at the end of its last token.
_OF_BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
#: Lower-cased words of letters that no other normal form, case or cut can change, and the same in either case.
_PLAIN, _LETTERS = "^[a-z\u00df-\u00f6\u00f8-\u00ff]+$", "^[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+$"
#: Documents that are read back at a time, bytes of texts encoded at a time, new words encoded as one text.
DOCS, TEXT_BYTES, _TOGETHER = 2000, 1 << 24, 200


class TextIds:
    """The ids of whole texts as the tokenizers library gives them.

    For tokenizers of the kind in _BY_WORDS a text's ids are those of its words, and words of ASCII or of Latin-1 letters
    alone can be lower-cased first: each word is then encoded once and remembered. Other tokenizers, and texts that hold the
    string of a special token, get the library's own encoding of the whole text. Ids from 65,536 on are an error.
    """

    def __init__(self, path: str, remembered: int = 600_000) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer, self.of_words, self.of_letters = (Tokenizer.from_file(path) for _ in range(3))
        self.of_words.encode_special_tokens = True  # lower-cased words may look like a special token
        spec = json.loads(self.tokenizer.to_str())
        cut, *others = (spec["pre_tokenizer"] or {}).get("pretokenizers", [None])
        self.by_words = (((spec["normalizer"] or {}).get("normalizers")), cut) == _BY_WORDS and all(t["special"] and not t["normalized"] for t in spec["added_tokens"])
        self.specials = [t["content"] for t in spec["added_tokens"]]
        if self.tokenizer.get_vocab_size() > IDS:
            raise ValueError(f"ids of this tokenizer reach {IDS}")
        # plain words need neither another form nor a cut, and the last token of each has a mark
        mark, self.ends_word = spec["model"].get("end_of_word_suffix"), np.zeros(IDS, dtype=bool)
        if mark and others == [_OF_BYTES]:
            self.ends_word[[i for token, i in self.tokenizer.get_vocab().items() if token.endswith(mark)]] = True
        self.of_letters.normalizer = normalizers.Sequence([])
        self.of_letters.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.remembered, self.known = remembered, pa.array([], pa.string())
        self.flat, self.ends = np.zeros(0, dtype=np.uint16), np.zeros(1, dtype=np.int64)
        self.uses = np.zeros(0, dtype=np.int64)

    def _forget(self, but: np.ndarray) -> None:
        """Keep only the words with these numbers."""
        self.known, self.uses = self.known.take(pa.array(but)), np.zeros(len(but), dtype=np.int64)
        self.flat, self.ends = _gathered(self.flat, self.ends, but)

    def _learn(self, words: pa.Array) -> None:
        """Encode new words, many as one text."""
        plain = np.zeros(len(words), dtype=bool)
        if self.ends_word.any():
            plain = pc.match_substring_regex(words, _PLAIN).to_numpy(zero_copy_only=False)
        ids, lengths, order = [], [], np.concatenate([np.flatnonzero(plain), np.flatnonzero(~plain)])
        for which, of in ((order[: plain.sum()], self._of_plain), (order[plain.sum() :], self._of_others)):
            some = words.take(pa.array(which))
            offsets = np.minimum(np.arange(0, len(some) + _TOGETHER, _TOGETHER), len(some))
            for text, at in zip(pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), some), " ").to_pylist(), offsets.tolist(), strict=False):
                found, n = of(text, some[at : at + _TOGETHER])
                ids.append(found)
                lengths.append(n)
        cuts = np.concatenate([[0], np.cumsum(np.concatenate(lengths))])
        flat, cuts = _gathered(np.concatenate(ids), cuts, np.argsort(order))
        self.flat, self.ends = np.concatenate([self.flat, flat]), np.concatenate([self.ends, self.ends[-1] + cuts[1:]])
        self.known, self.uses = pa.concat_arrays([self.known, words]), np.concatenate([self.uses, np.zeros(len(words), dtype=np.int64)])

    def _of_plain(self, text: str, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of plain words and how many each has, by the marks at their ends."""
        ids = np.array(self.of_letters.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype=np.uint16)
        last = np.flatnonzero(self.ends_word[ids])
        if len(last) != len(words) or last[-1] != len(ids) - 1:
            return self._of_others(text, words)  # some letter has no token
        return ids, np.diff(last, prepend=-1)

    def _of_others(self, text: str, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of any words and how many each has; a token belongs to the word in which it begins."""
        found = self.of_words.encode(text, add_special_tokens=False)
        begins = np.cumsum(pc.utf8_length(words).to_numpy() + 1, dtype=np.int64)[:-1]
        of = np.searchsorted(begins, np.array([a for a, _ in found.offsets], dtype=np.int64), side="right")
        return np.array(found.ids, dtype=np.uint16), np.bincount(of, minlength=len(words))

    def _by_words(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the texts, one after another, and where each text begins and the last one ends."""
        if len(self.known) > self.remembered:
            again = np.flatnonzero(self.uses > 1)
            self._forget(again if 2 * len(again) < self.remembered else again[:0])
        # distinct words first, then what signs part them into: both steps are small beside the texts
        split = pc.ascii_split_whitespace(texts)
        words = split.flatten().dictionary_encode()
        # other words are left to the library: a capital and a mark may compose, or not, before they are lower-cased
        ascii_only = pc.string_is_ascii(words.dictionary)
        some = words.dictionary.filter(pc.invert(ascii_only))
        some = pc.if_else(pc.match_substring_regex(some, _LETTERS), pc.utf8_lower(some), some)
        low = pc.replace_with_mask(pc.ascii_lower(words.dictionary), pc.invert(ascii_only), some)
        parted = pc.ascii_split_whitespace(pc.replace_substring_regex(low, _SEAM, r"\1 \2"))
        parts = parted.flatten().dictionary_encode()
        number = pc.index_in(parts.dictionary, value_set=self.known).fill_null(-1).to_numpy().astype(np.int64)
        new = np.flatnonzero(number < 0)
        if len(new):
            number[new] = len(self.known) + np.arange(len(new))
            self._learn(parts.dictionary.take(pa.array(new)))
        self.uses[number] += 1
        part_ids, part_cuts = _gathered(self.flat, self.ends, number[parts.indices.to_numpy()])
        ids, cuts = _gathered(part_ids, part_cuts[parted.offsets.to_numpy()], words.indices)
        offsets = split.offsets.to_numpy()
        return ids, cuts[offsets - offsets[0]]

    def of(self, texts: pa.Array, end: int = END_ID) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after another and each with the end id, and how many each has."""
        whole = np.full(len(texts), not self.by_words)
        # what all special tokens begin with is rare
        if self.by_words and pc.any(pc.match_substring(texts, os.path.commonprefix(self.specials))).as_py():
            for token in self.specials:
                whole |= pc.match_substring(texts, token).to_numpy(zero_copy_only=False)
        rest = texts.filter(pa.array(~whole)) if whole.any() else texts
        ids, cuts = self._by_words(rest)
        counts = np.zeros(len(texts), dtype=np.int64)
        counts[~whole] = np.diff(cuts)
        if whole.any():
            found = [np.array(e.ids, dtype=np.uint16) for e in self.tokenizer.encode_batch(texts.filter(pa.array(whole)).to_pylist(), add_special_tokens=False)]
            parts: list[np.ndarray] = [None] * len(texts)
            for at, part in zip([*np.flatnonzero(~whole), *np.flatnonzero(whole)], [*np.split(ids, cuts[1:-1])[: len(rest)], *found], strict=True):
                parts[at] = part
            counts[whole] = [len(x) for x in found]
            ids = np.concatenate(parts)
        return np.insert(ids, np.cumsum(counts), np.uint16(end)), counts + 1


def _gathered(flat: np.ndarray, ends: np.ndarray, which: np.ndarray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The runs flat[ends[i]:ends[i + 1]] for each i of `which`, one after another, and where each begins and the last ends."""
    runs = pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), pa.array(flat)).take(pa.array(which))
    return runs.flatten().to_numpy(), runs.offsets.to_numpy()


_KNOWN: dict[str, TextIds] = {}


def text_ids(path: str) -> TextIds:
    """The words that this Python worker remembers, from task to task."""
    if path not in _KNOWN:
        _KNOWN[path] = TextIds(path)
    return _KNOWN[path]


def packed(doc_ids: pa.Array, flat: np.ndarray, counts: np.ndarray) -> bytes:
    """The payload of a segment: doc_ids (long), all ids one after another, and how many each document has."""
    blocks = encoded(flat)
    docs, heads = np.zeros(len(doc_ids), dtype=_DOC), np.zeros(len(blocks), dtype=_BLOCK)
    docs["id"], docs["null"], docs["n"] = doc_ids.fill_null(0).to_numpy(), doc_ids.is_null().to_numpy(zero_copy_only=False), counts
    heads["n"], heads["bytes"], heads["crc"] = BLOCK, [len(b) for b in blocks], [zlib.crc32(b) for b in blocks]
    heads["n"][-1] = len(flat) - (len(blocks) - 1) * BLOCK
    return b"".join([b"TIDS", np.array([len(docs), len(blocks)], dtype="<u4").tobytes(), docs.tobytes(), heads.tobytes(), *blocks])


def unpacked(payload: bytes) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """doc_ids, all ids and the documents' counts of a segment; a block that doesn't match its checksum is an error."""
    if payload[:4] != b"TIDS":
        raise ValueError("not a segment of token ids")
    n_docs, n_blocks = np.frombuffer(payload, dtype="<u4", count=2, offset=4).tolist()
    docs = np.frombuffer(payload, dtype=_DOC, count=n_docs, offset=12)
    heads = np.frombuffer(payload, dtype=_BLOCK, count=n_blocks, offset=12 + docs.nbytes)
    at, blocks = 12 + docs.nbytes + heads.nbytes, []
    for i, head in enumerate(heads):
        blocks.append(payload[at : at + int(head["bytes"])])
        at += int(head["bytes"])
        if zlib.crc32(blocks[-1]) != head["crc"]:
            raise ValueError(f"block {i} is damaged")
    return pa.array(docs["id"], mask=docs["null"].astype(bool)), decoded(blocks, heads["n"].tolist()), docs["n"].astype(np.int64)


def written(docs: DataFrame, tokenizer: str, segment_ids: int = SEGMENT_IDS) -> DataFrame:
    """Encode docs(doc_id, text) and write the segments: part, segment, n_docs, n_ids and payload.

    Documents are dealt by ranges of doc_id, and of a text's hash where many share one, so that no task has more than
    its share; part and segment number the segments in ascending order of doc_id.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, n, part = text_ids(tokenizer), 0, 0
        names: list[pa.Array] = []
        ids: list[np.ndarray] = []
        counts: list[np.ndarray] = []

        def segment() -> pa.RecordBatch:
            flat, each_n = np.concatenate(ids), np.concatenate(counts)
            values = (part, n, len(each_n), len(flat), packed(pa.concat_arrays(names), flat, each_n))
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names=["part", "segment", "n_docs", "n_ids", "payload"])

        for whole in batches:
            ends = np.cumsum(pc.binary_length(whole.column(1)).to_numpy(), dtype=np.int64)
            cuts = np.flatnonzero(np.diff(ends // TEXT_BYTES)) + 1
            for at, to in zip([0, *cuts], [*cuts, whole.num_rows], strict=True):
                batch = whole.slice(at, to - at)
                part = batch.column(2)[0].as_py()
                flat, each_n = coder.of(batch.column(1))
                begin = 0
                while begin < len(each_n):  # as many documents as end the segment
                    room = segment_ids - sum(map(len, ids))
                    sums = np.cumsum(each_n[begin:])
                    end = begin + min(int(np.searchsorted(sums, room)) + 1, len(sums))
                    names.append(batch.column(0)[begin:end])
                    counts.append(each_n[begin:end])
                    ids.append(flat[: sums[end - begin - 1]])
                    flat = flat[sums[end - begin - 1] :]
                    begin = end
                    if sum(map(len, ids)) >= segment_ids:
                        yield segment()
                        n += 1
                        names, ids, counts = [], [], []
        if ids:
            yield segment()

    text = text_or_empty(F.col("text"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("k"), text.alias("text"))
    dealt = rows.repartitionByRange("doc_id", "k").sortWithinPartitions("doc_id", "k").select("doc_id", "text", F.spark_partition_id().alias("part"))
    return saved(dealt.mapInArrow(each, "part int, segment int, n_docs long, n_ids long, payload binary"), "token-files")


def read_back(segments: DataFrame) -> DataFrame:
    """(doc_id, start, ids) of every document from the segments; start: ids of all documents before it."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                names, flat, counts = unpacked(payload)
                ends = np.cumsum(counts)
                data, begins = pa.py_buffer(flat.astype("<u4")), np.concatenate([[0], 4 * ends])
                for at in range(0, len(ends), DOCS):
                    k = min(DOCS, len(ends) - at)
                    offsets = (begins[at : at + k + 1] - begins[at]).astype(np.int32)
                    ids = pa.Array.from_buffers(pa.binary(), k, [None, pa.py_buffer(offsets), data.slice(int(begins[at]))])
                    yield pa.RecordBatch.from_arrays([names[at : at + k], pa.array(start + (ends - counts)[at : at + k]), ids], names=["doc_id", "start", "ids"])

    # one row a segment of millions of ids
    before = F.sum("n_ids").over(Window.orderBy("part", "segment").rowsBetween(Window.unboundedPreceding, -1))
    starts = segments.select("part", "segment", F.coalesce(before, F.lit(0)).cast("long").alias("start"))
    return segments.select("part", "segment", "payload").join(starts, ["part", "segment"]).select("start", "payload").mapInArrow(each, "doc_id long, start long, ids binary")


def token_index(docs: DataFrame, tokenizer: str, segment_ids: int = SEGMENT_IDS) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every row of docs(doc_id, text), from files written and read back.

    A document's ids are those of its whole text and the end id; a null or empty text has the end id alone. A null
    doc_id comes first; rows with one doc_id follow each other in the order of their texts' hashes; an empty table
    gives no rows; other columns are ignored. ids_crc32 is the CRC-32 of the ids as unsigned 32-bit integers.
    """
    out = read_back(written(docs, tokenizer, segment_ids))
    return out.select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
