"""SentencePiece encoding and decoding by a relational lattice.

A text is cut at spaces and line ends into words ("\\u2581" stands for the space before a word; a line
end is a word of its own). A word's lattice has an edge for each substring of bounded length that is
a piece, and for each character that is no piece an edge of its byte pieces. The best path (largest
sum of scores, ties to the longest last piece) is the word's encoding, and a text is the encodings
of its words one after the other. Decoding undoes it exactly, whatever the text.

Word counts are made over all texts. For the most frequent words (at most HOT), which make up most
occurrences, the lattice is a Spark job: substrings are exploded, joined to the piece table
(broadcast; its size is the model's), grouped by word and folded by the higher-order aggregate. The
table that comes out is of bounded size and is broadcast to the tasks that write the texts' codes.
Words beyond it are rare and mostly stand once; shuffling their lattices' edges would take many
times the input, so a task runs the same recurrence over the substrings of those that it meets, all
that are new in some texts at once.

The path maximises the sum of the model's scores; a model that was trained for merges may cut some
words otherwise than its own library does.

Defined results: a null text has null codes and an empty one none; repeated rows are coded one by
one; a text of any length is coded whole, with memory for its codes; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.components import cut, least_count

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: No more words than this are coded by the Spark lattice and broadcast.
HOT = 1 << 16
#: Tasks that build their lattices; the words are few but each takes some steps.
TASKS = 24
#: Words whose codes a task remembers beyond the broadcast ones; after the first FREE of them only words that it meets again.
REMEMBERED = 100_000
FREE = 25_000
#: Bits for the hashes of words that a task has met once; words that share one are remembered sooner.
MET = 1 << 24
#: Words of texts that a task codes together, but for a longer text.
TOGETHER = 20_000
#: Longer words are coded one by one.
LONG = 64
#: Bits of a character in the keys of the piece table.
CHARACTER = 21
#: Distinct words that a task counts before it hands them on; Spark sums them further before the shuffle.
COUNTED = 100_000

PUNCTUATION = ".,!?;:|*$%&#"
_CROSSING = re.compile(f"[A-Za-zÀ-ÖØ-öø-ÿ][{re.escape(PUNCTUATION)}]")
_CODES, _DECODED = itemgetter(0), itemgetter(1)
_NONE = (None, None, None)
_LETTER = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]").match
_WORD = re.compile(r"\n| ?[^ \n]+| ")


@dataclass
class Table:
    """Pieces' beginnings by number, the empty one is 0: sorted keys (beginning, next character) and where they lead; scores and ids by number."""

    keys: np.ndarray
    to: np.ndarray
    scores: np.ndarray
    ids: np.ndarray


@dataclass
class Pieces:
    """The piece table: ids and scores of pieces, the ids of bytes, and the score of a byte."""

    ids: dict[str, int]
    scores: dict[str, float]
    byte_ids: list[int]
    byte_score: float

    @cached_property
    def tree(self) -> dict:
        """The pieces' beginnings as a tree: character -> (what follows, score and code; minus infinity and None where it is no piece)."""
        found: dict = {}
        for piece, i in self.ids.items():
            node = found
            for c in piece[:-1]:
                node = node.setdefault(c, ({}, -math.inf, None))[0]
            node[piece[-1]] = (node.get(piece[-1], ({},))[0], self.scores[piece], [i])
        return found

    @cached_property
    def ends_apart(self) -> bool:
        """Whether no piece reaches from a letter into punctuation, so that a word can be cut there."""
        return not any(_CROSSING.search(p) for p in self.ids)

    @cached_property
    def table(self) -> Table:
        """The same tree as arrays, for many places at once."""
        nodes = {"": 0}
        for piece in self.ids:
            for n in range(1, len(piece) + 1):
                nodes.setdefault(piece[:n], len(nodes))
        steps = list(nodes)[1:]
        keys = np.array([nodes[x[:-1]] << CHARACTER | ord(x[-1]) for x in steps], dtype=np.int64)
        order = np.argsort(keys)
        return Table(keys[order], order.astype(np.int32) + 1, np.array([self.scores.get(x, -math.inf) for x in nodes]), np.array([self.ids.get(x, -1) for x in nodes], dtype=np.int32))

    @property
    def longest(self) -> int:
        return max(map(len, self.ids), default=1)


def load(path: str = MODEL) -> Pieces:
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    own = [i for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
    scores = {model.id_to_piece(i): float(model.get_score(i)) for i in own}
    byte_ids = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
    return Pieces({model.id_to_piece(i): i for i in own}, scores, byte_ids, min(scores.values()) - 10)


def cut_words(text: str) -> list[str]:
    return _WORD.findall(" " + text)


def lattice_form(word: str) -> str:
    """A space becomes SPACE as the pieces have it; a SPACE of the text itself becomes NUL, which is in no piece."""
    return word.replace(SPACE, "\0").replace(" ", SPACE)


def encode_word(word: str, pieces: Pieces) -> list[int]:
    """The best path through the word's lattice."""
    form, n, tree = lattice_form(word), len(word), pieces.tree
    score = [0.0] + [-math.inf] * n
    back, codes = [0] * (n + 1), [[]] * (n + 1)
    for start in range(n):
        base, node, end = score[start], tree, start
        for c in form[start:]:
            found = node.get(c)
            if found is None:  # no piece begins so
                break
            end += 1
            node, own, code = found
            if (total := base + own) > score[end]:
                score[end], back[end], codes[end] = total, start, code
            if not node:
                break
        if not tree.get(form[start], _NONE)[2]:  # the character is no piece: its bytes
            code = [pieces.byte_ids[b] for b in word[start].encode()]
            if (total := base + len(code) * pieces.byte_score) > score[start + 1]:
                score[start + 1], back[start + 1], codes[start + 1] = total, start, code
    path, at = [], n
    while at:
        path.append(codes[at])
        at = back[at]
    return [i for code in reversed(path) for i in code]


def encode_words(words: list[str], pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """encode_word of all words, one after the other, and where each one ends.

    All lattices are laid out together, and best paths go on a place of all words at a time.
    """
    whole, table = lattice_form("".join(words)), pieces.table
    chars = np.frombuffer(whole.encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    word = np.repeat(np.arange(len(words)), sizes)
    ends = np.cumsum(sizes)
    known = np.zeros(len(chars), dtype=bool)
    alone = sizes > LONG
    at = np.flatnonzero(~alone[word])
    node, end, edges = np.zeros(len(at), dtype=np.int64), ends[word[at]], []
    for n in range(1, pieces.longest + 1):
        key = node << CHARACTER | chars[at + n - 1]
        i = np.searchsorted(table.keys, key)
        met = table.keys[np.minimum(i, len(table.keys) - 1)] == key
        at, node, end = at[met], table.to[i[met]].astype(np.int64), end[met]
        piece = table.ids[node] >= 0
        edges.append((at[piece], np.full(piece.sum(), n), node[piece]))
        if n == 1:
            known[edges[0][0]] = True
        more = at + n < end
        at, node, end = at[more], node[more], end[more]
        if not len(at):
            break
    # Bytes of characters that are no pieces: few words have any.
    alone[word[~known]] = True
    start, n, node = (np.concatenate(x) for x in zip(*edges, strict=True))
    place = (start - (ends - sizes)[word[start]]).astype(np.uint16)
    order = np.argsort(place, kind="stable")
    bounds = np.searchsorted(place[order], np.arange(LONG + 1))
    # A word has a place more than characters.
    start, n, node = start[order] + word[start[order]], n[order], node[order]
    reach, own = start + n, table.scores[node]
    first = ends - sizes + np.arange(len(words))
    score, back = np.full(len(chars) + len(words), -math.inf), np.zeros(len(chars) + len(words), dtype=np.int64)
    score[first] = 0.0
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        total = score[start[a:b]] + own[a:b]
        better = np.flatnonzero(total > score[reach[a:b]])
        score[reach[a + better]] = total[better]
        back[reach[a + better]] = a + better
    going = np.flatnonzero(~alone)
    last, taken, n_codes = first[going] + sizes[going], [], np.zeros(len(words), dtype=np.int64)
    while len(going):
        edge = back[last]
        taken.append((going, table.ids[node[edge]]))
        n_codes[going] += 1
        last = start[edge]
        more = last > first[going]
        going, last = going[more], last[more]
    others = {i: encode_word(words[i], pieces) for i in np.flatnonzero(alone).tolist()}
    for i, codes in others.items():
        n_codes[i] = len(codes)
    stops = np.cumsum(n_codes)
    out = np.empty(n_codes.sum(), dtype=np.int32)
    for k, (at, codes) in enumerate(taken, 1):
        out[stops[at] - k] = codes
    for i, codes in others.items():
        out[stops[i] - len(codes) : stops[i]] = codes
    return out, stops


def lattice(words: DataFrame, pieces: Pieces) -> DataFrame:
    """(word, ids) for a table of distinct words, as a Spark job."""
    spark, longest = words.sparkSession, pieces.longest
    table = F.broadcast(spark.createDataFrame([(p, i, pieces.scores[p]) for p, i in pieces.ids.items()], "part string, id int, score double"))
    form = words.select("word", F.replace(F.replace("word", F.lit(SPACE), F.lit("\0")), F.lit(" "), F.lit(SPACE)).alias("form"), F.char_length("word").alias("n"))
    starts = form.select("word", "form", "n", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("s"))
    parts = starts.select("word", "form", "s", F.explode(F.sequence(F.col("s") + 1, F.least("n", F.col("s") + longest))).alias("e"))
    joined = parts.withColumn("part", F.substring("form", F.col("s") + 1, F.col("e") - F.col("s"))).join(table, "part", "left")
    byte_ids = F.array(*[F.lit(i) for i in pieces.byte_ids])
    hexed = F.hex(F.encode(F.substring("word", F.col("s") + 1, F.lit(1)), "UTF-8"))
    code = F.transform(F.sequence(F.lit(1), (F.length(hexed) / 2).cast("int")), lambda k: F.element_at(byte_ids, F.conv(F.substring(hexed, 2 * k - 1, F.lit(2)), 16, 10).cast("int") + 1))
    edges = joined.where("id is not null or e = s + 1").select("word", "s", "e", F.when(F.col("id").isNull(), 1).otherwise(0).alias("kind"), F.when(F.col("id").isNull(), code).otherwise(F.array("id")).alias("ids"), "score")
    scored = edges.withColumn("score", F.coalesce("score", F.size("ids") * F.lit(pieces.byte_score)))
    grouped = scored.groupBy("word").agg(F.sort_array(F.collect_list(F.struct("e", "s", "kind", "score", "ids"))).alias("edges"))

    def step(best, x):
        path = F.struct((F.get(best, x["s"])["score"] + x["score"]).alias("score"), F.concat(F.get(best, x["s"])["ids"], x["ids"]).alias("ids"))
        better = path["score"] > F.get(best, x["e"])["score"]
        return F.when(F.size(best) == x["e"], F.array_append(best, path)).when(better, F.array_append(F.slice(best, F.lit(1), x["e"]), path)).otherwise(best)

    start = F.array(F.struct(F.lit(0.0).alias("score"), F.array().cast("array<int>").alias("ids")))
    return grouped.select("word", F.aggregate("edges", start, step, lambda best: F.element_at(best, -1)["ids"]).alias("ids"))


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) over all texts; each task sums what it has read before the shuffle."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[str] = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["word", "n"])
            found.clear()
            return out

        for batch in batches:
            for text in batch.column("text"):
                found.update(cut_words(text.as_py() or ""))
                if len(found) > COUNTED:
                    yield flush()
        yield flush()

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def hot_table(docs: DataFrame, pieces: Pieces, hot: int = HOT) -> dict[str, list[int]]:
    """The codes of the most frequent words."""
    counts = cut(word_counts(docs))
    top = counts.where(F.col("n") >= least_count(counts, hot)).select("word").repartition(TASKS, "word")
    found = lattice(top, pieces).toArrow()
    return dict(zip(found["word"].to_pylist(), found["ids"].to_pylist(), strict=True))


def decode_ids(ids: list[int] | None, names: dict[int, bytes]) -> str | None:
    if ids is None:
        return None
    return b"".join([names[i] for i in ids]).decode()[1:]


def piece_bytes(pieces: Pieces) -> dict[int, bytes]:
    return {i: p.replace(SPACE, " ").encode() for p, i in pieces.ids.items()} | {i: bytes([b]) for b, i in enumerate(pieces.byte_ids)}


Entry = tuple[bytes, bytes]


def entry(ids: list[int], names: dict[int, bytes]) -> Entry:
    """Ids as 32-bit numbers, and what they decode to. Both of a text are those of its words in a row."""
    return array("i", ids).tobytes(), b"".join(map(names.__getitem__, ids))


class Codes(dict):
    """The entries of words: the broadcast ones, and those that this task has met (at most REMEMBERED).

    Most rare words stand once in a task, and entries of them all would be most of its memory. So
    when FREE words are remembered, a word is coded twice before it is.
    """

    def __init__(self, known: dict[str, Entry], pieces: Pieces):
        super().__init__(known)
        self.known, self.pieces, self.names, self.met = known, pieces, piece_bytes(pieces), bytearray(MET // 8)

    def parts(self, word: str) -> tuple[str, str]:
        """A word and the punctuation at its end, if no piece reaches from the one into the other."""
        bare = word.rstrip(PUNCTUATION)
        return (bare, word[len(bare) :]) if self.pieces.ends_apart and bare and _LETTER(bare[-1]) else (word, "")

    def coded(self, words: Iterable[str]) -> dict[str, Entry]:
        """The entries of words that have none yet, all at once."""
        found, new = {}, []
        for word in words:
            bare, rest = self.parts(word)
            own = self.get(bare) if rest else None
            if own:
                more = self[rest]
                found[word] = (own[0] + more[0], own[1] + more[1])
            else:
                new.append(word)
        if new:
            ids, stops = encode_words(new, self.pieces)
            names, ids, at = list(map(self.names.__getitem__, ids.tolist())), ids.tobytes(), 0
            for word, end in zip(new, stops.tolist(), strict=True):
                found[word] = (ids[4 * at : 4 * end], b"".join(names[at:end]))
                at = end
        return found

    def __missing__(self, word: str) -> Entry:
        bare, rest = self.parts(word)
        if rest:
            (ids, text), (more, end) = self[bare], self[rest]
            found = ids + more, text + end
        else:
            found = entry(encode_word(word, self.pieces), self.names)
        self.remember(word, found)
        return found

    def remember(self, word: str, found: Entry) -> None:
        remembered = len(self) - len(self.known)
        if remembered >= FREE:
            at, bit = divmod(hash(word) % MET, 8)
            if not self.met[at] >> bit & 1:
                self.met[at] |= 1 << bit
                return
        if remembered >= REMEMBERED:
            self.clear()
            self.update(self.known)
            self.met = bytearray(MET // 8)
        self[word] = found

    def of_texts(self, texts: list[list[str]]) -> list[list[Entry]]:
        """The entries of the words of each text; what is new in them is coded at once."""
        entries = [list(map(self.get, words)) for words in texts]
        holes = [[i for i, x in enumerate(own) if x is None] if None in own else [] for own in entries]
        found = self.coded({words[i] for words, own in zip(texts, holes, strict=True) for i in own})
        for words, own, filled in zip(texts, holes, entries, strict=True):
            for i in own:
                filled[i] = found[words[i]]
        for w, own in found.items():
            self.remember(w, own)
        return entries


def together(texts: Iterable[str | None]) -> Iterator[list[list[str] | None]]:
    """The words of the texts (None for a null), in runs of TOGETHER words or one text more."""
    run, n = [], 0
    for text in texts:
        run.append(text if text is None else cut_words(text) if text else [])
        n += len(run[-1] or ())
        if n >= TOGETHER:
            yield run
            run, n = [], 0
    if run:
        yield run


def encode(docs: DataFrame, pieces: Pieces, hot: int = HOT) -> DataFrame:
    """doc_id, ids, n_pieces, n_words and round_trip (decoding gives the text again) of every row."""
    names = piece_bytes(pieces)
    shared = docs.sparkSession.sparkContext.broadcast(({w: entry(ids, names) for w, ids in hot_table(docs, pieces, hot).items()}, pieces))

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = Codes(*shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = part.column("text").to_pylist()
                out, sizes, same = [], [], []
                for run in together(texts):
                    entries = iter(codes.of_texts([words for words in run if words is not None]))
                    for words in run:
                        text = texts[len(out)]
                        if words is None:
                            out.append(None)
                            sizes.append(0)
                            same.append(None)
                            continue
                        found = next(entries)
                        out.append(np.frombuffer(b"".join(map(_CODES, found)), dtype=np.int32))
                        sizes.append(len(words))
                        same.append(b"".join(map(_DECODED, found)) == (" " + text if text else "").encode())
                column = pa.array(out, pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), column, pa.array([0 if x is None else len(x) for x in out], pa.int64()), pa.array(sizes, pa.int64()), pa.array(same, pa.bool_())], ["doc_id", "ids", "n_pieces", "n_words", "round_trip"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(coded, f"doc_id {kind}, ids array<int>, n_pieces long, n_words long, round_trip boolean")


def decode(codes: DataFrame, pieces: Pieces) -> DataFrame:
    """doc_id and text of rows with doc_id and ids."""
    shared = codes.sparkSession.sparkContext.broadcast(piece_bytes(pieces))

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([decode_ids(x, shared.value) for x in batch.column("ids").to_pylist()], pa.string())], ["doc_id", "text"])

    return codes.select("doc_id", "ids").mapInArrow(texts, f"doc_id {codes.schema['doc_id'].dataType.simpleString()}, text string")
