"""Toxicity of documents: obfuscated words are restored by a noisy channel, then the restored text is scored.

Words written with digits and signs for letters, with gaps between their letters or
with repeated letters are lattices of what each character may stand for. Viterbi
decoding under a character trigram model of the whole corpus picks the reading.
The scorer weighs word beginnings and whole words by how much more often labelled
toxic documents have them than others."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haggle.llm import pretokens
from haggle.llm.arrays import span_hashes, text_slices

#: Labelled rows of the fit at most, by the order of a hash of their ids.
TRAIN_ROWS = 30_000
#: Words from so many letters on are terms, and beginnings of words of so many letters.
LEAST_WORD, PREFIXES = 2, (4, 5, 6, 7)
#: A term counts with so many labelled toxic documents, and this much log odds for toxic ones.
TERM_DOCS, TERM_WEIGHT = 3, 2.0
#: A document is rejected from this score on.
REJECT = 0.7

# Symbols of the character model: 0 is no letter, 1-26 are a-z, then the letters of
# Latin-1 from sharp s on, and one symbol for all other letters.
_LATIN = 27
_OTHER_LETTER = _LATIN + 33
SYMBOLS = _OTHER_LETTER + 1

# Letters that a sign may stand for.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "€": "e", "£": "l",
}
# Signs put between the letters of one word.
GAPS = " .-_*~,/"
#: Costs in natural logarithms: a sign read as a letter, a sign or gap dropped, a repeated letter dropped, one kept.
READ, DROP, GAP, ONCE, AGAIN = 0.7, 12.0, 0.1, 0.2, 1.5

_LETTER = r"[^\W\d_]"
_SIGN = "[" + re.escape("".join(LEET)) + "]"
#: As the last of a word, "!" ends a sentence more often than it is a letter.
_LAST = "[" + re.escape("".join(LEET).replace("!", "")) + "]"
#: A word with signs before a letter or behind the last one, a run of single letters with gaps, or a letter three times in a row.
_SUSPECT = re.compile(
    rf"(?<![^\W_])(?<!{_SIGN})(?:{_LETTER}|{_SIGN})*(?:{_SIGN}{_LETTER}|{_LETTER}{_SIGN}*{_LAST})(?:{_LETTER}|{_SIGN})*(?<!!)"
    rf"|(?<![^\W_])(?:{_LETTER}|{_SIGN})(?:[{re.escape(GAPS)}](?:{_LETTER}|{_SIGN})){{2,}}(?![^\W_])"
    rf"|(?:{_LETTER})*({_LETTER})\1\1(?:{_LETTER})*",
    re.IGNORECASE,
)


def _table() -> np.ndarray:
    table = np.where(pretokens.classes() == pretokens.LETTER, _OTHER_LETTER, 0).astype(np.uint8)
    for k in range(26):
        table[[65 + k, 97 + k]] = 1 + k
    for k, cp in enumerate(range(0xDF, 0x100)):
        if table[cp]:
            table[cp] = _LATIN + k
            upper = chr(cp).upper()
            if len(upper) == 1:
                table[ord(upper)] = _LATIN + k
    return table


_symbols: list[np.ndarray] = []


def symbols(text: str) -> np.ndarray:
    """The text's characters as symbols of the model."""
    if not _symbols:
        _symbols.append(_table())
    return _symbols[0][np.frombuffer(text.encode("utf-32-le"), np.uint32)]


@dataclass(frozen=True)
class CharacterModel:
    """Log probabilities of a symbol after two others."""

    logp: np.ndarray

    @cached_property
    def digest(self) -> bytes:
        """Names the model by what it says, wherever a copy of it lies."""
        return hashlib.blake2b(self.logp.tobytes(), digest_size=16).digest()

    @staticmethod
    def of_counts(counts: np.ndarray) -> CharacterModel:
        counts = counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS).astype(np.float64)
        two = counts.sum(axis=0) + 0.5
        back = two / two.sum(axis=1, keepdims=True)
        smooth = counts + 5.0 * back[None, :, :]
        return CharacterModel(np.log(smooth / smooth.sum(axis=2, keepdims=True)).astype(np.float32))

    def restore(self, span: str) -> str:
        """The likeliest word behind a suspect span, in lower case."""
        low = span.lower()
        best: dict[tuple[int, int], tuple[float, str]] = {(0, 0): (0.0, "")}
        logp = self.logp
        for k, c in enumerate(low):
            repeated = k > 0 and low[k - 1] == c and ((k > 1 and low[k - 2] == c) or low[k + 1 : k + 2] == c)
            options: list[tuple[str, float]]
            if c in LEET:
                options = [(x, READ) for x in LEET[c]] + [("", ONCE if repeated else DROP)]
            elif c in GAPS:
                options = [("", GAP)]
            else:
                options = [(c, AGAIN), ("", ONCE)] if repeated else [(c, 0.0)]
            step: dict[tuple[int, int], tuple[float, str]] = {}
            coded = [(x, int(symbols(x)[0]) if x else -1, cost) for x, cost in options]
            for (a, b), (score, word) in best.items():
                for x, s, cost in coded:
                    to, value = ((a, b), score - cost) if s < 0 else ((b, s), score - cost + float(logp[a, b, s]))
                    if to not in step or value > step[to][0]:
                        step[to] = (value, word + x)
            best = step
        ends = [(score + float(logp[a, b, 0]), word) for (a, b), (score, word) in best.items()]
        return max(ends)[1]


#: What a worker has read under the model of this digest; another model starts anew.
_restored: tuple[bytes, dict[str, str]] = (b"", {})
#: Restored spans that a worker remembers.
MEMORY = 1 << 16


def restore(text: str, model: CharacterModel) -> str:
    """The text with each suspect span replaced by its likeliest reading; all else stays."""
    global _restored
    if _restored[0] != model.digest:
        _restored = (model.digest, {})
    known = _restored[1]

    def read(m: re.Match) -> str:
        span = m.group()
        if span not in known:
            if len(known) >= MEMORY:
                known.clear()
            known[span] = model.restore(span)
        return f"{known[span]} "

    return _SUSPECT.sub(read, text)


def _hits(data: np.ndarray) -> np.ndarray:
    """Bytes at which a suspect span may be: a sign beside a letter or behind "!", three letters
    that may be the same, or single letters two gaps apart. Every suspect span has one."""
    kind = np.zeros(256, np.uint8)
    kind[[*range(65, 91), *range(97, 123), *range(0x80, 0x100)]] = 1
    kind[[b for b in b"0123456789@$!|+"]] = 2
    kind[[b for b in GAPS.encode()]] = 3
    k = kind[data]
    n = len(data)
    if n <= 14:
        return np.arange(n)
    for sign in ("€", "£"):
        raw = sign.encode()
        at = np.flatnonzero(data[: n - len(raw) + 1] == raw[0])
        for j, byte in enumerate(raw):
            at = at[data[at + j] == byte]
        for j in range(len(raw)):
            k[at + j] = 2
    hit = np.zeros(n, bool)
    low = data | 0x20
    call = data == 0x21
    hit[:-1] = (k[:-1] == 2) & (k[1:] == 1)
    hit[:-1] |= ((k[:-1] == 1) | call[:-1]) & (k[1:] == 2) & ~call[1:]
    hit[:-2] |= (k[:-2] == 1) & (low[:-2] == low[1:-1]) & (low[1:-1] == low[2:])
    # capitals and small letters differ in any byte but the first: three characters of as many bytes
    lead = np.zeros(256, np.uint8)
    lead[0xC2:0xE0], lead[0xE0:0xF0], lead[0xF0:] = 2, 3, 4
    size = lead[data]
    for w in (2, 3, 4):
        hit[: -2 * w] |= (size[: -2 * w] == w) & (size[w:-w] == w) & (size[2 * w :] == w)
    # letter, gap, one character of at most four bytes, gap, letter
    any_, gap, more = (k == 1) | (k == 2), k == 3, data >= 0x80
    for w in (1, 2, 3, 4):
        m = n - 3 - w
        found = any_[:m] & gap[1 : 1 + m] & any_[2 : 2 + m] & gap[2 + w : 2 + w + m] & any_[3 + w :]
        for j in range(w if w > 1 else 0):
            found &= more[2 + j : 2 + j + m]
        hit[:m] |= found
    return np.flatnonzero(hit)


def _apart(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Places that no suspect span reaches across: behind line feeds, and behind spaces after two letters
    or digits. Only spans of single letters hold a space, and those have one letter before it."""
    plain = np.zeros(256, bool)
    plain[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
    word, first = plain[data], np.zeros(len(data) + 1, bool)
    first[offsets] = True
    behind = np.zeros(len(data), bool)
    behind[2:] = (data[2:] == 0x20) & word[1:-1] & word[:-2] & ~first[1 : len(data) - 1]
    return np.flatnonzero(behind | (data == 0x0A)) + 1


def _restored_symbols(data: np.ndarray, offsets: np.ndarray, model: CharacterModel) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of the restored texts of a slice, and where each begins. Only stretches
    with a hit are searched, between places that no suspect span reaches across."""
    raw = data.tobytes()
    at = _hits(data)
    if len(at):
        cut = np.zeros(len(data) + 1, bool)
        cut[offsets] = cut[_apart(data, offsets)] = True
        cuts = np.flatnonzero(cut)
        of = np.searchsorted(cuts, at, side="right") - 1
        parts, ends, grown, done = [], [], [], 0
        for k in of[np.append(True, of[1:] != of[:-1])].tolist():
            a, b = int(cuts[k]), int(cuts[k + 1]) if k + 1 < len(cuts) else len(raw)
            read = restore(raw[a:b].decode(), model).encode()
            parts += [raw[done:a], read]
            ends.append(b)
            grown.append(len(read) - (b - a))
            done = b
        parts.append(raw[done:])
        raw = b"".join(parts)
        offsets = offsets + np.concatenate(([0], np.cumsum(grown)))[np.searchsorted(ends, offsets, side="right")]
    lead = np.concatenate(([0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)))
    return symbols(raw.decode()), lead[offsets]


def _terms(coded: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Words of all texts: (text of each word, hash of each word, and for every kind
    of term the words that have it and its hashes)."""
    letter = coded > 0
    edge = np.zeros(len(coded) + 1, bool)
    edge[bounds] = True
    begin = letter.copy()
    begin[1:] &= ~letter[:-1] | edge[1:-1]
    stop = letter.copy()
    stop[:-1] &= ~letter[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    long = ends - starts >= LEAST_WORD
    starts, ends = starts[long], ends[long]
    text = np.searchsorted(bounds, starts, side="right") - 1
    whole = span_hashes(coded, starts, ends)
    words, hashes = [np.arange(len(starts))], [whole ^ np.uint64(0x5555555555555555)]
    for k in PREFIXES:
        has = np.flatnonzero(ends - starts >= k)
        words.append(has)
        hashes.append(span_hashes(coded, starts[has], starts[has] + k))
    return text, whole, words, hashes


def _trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(SYMBOLS**3, np.int64)
    for batch in batches:
        for _, _, data, offsets in text_slices(batch, "text"):
            coded = np.concatenate(([0, 0], symbols(data.tobytes().decode()), [0, 0])).astype(np.int32)
            code = (coded[:-2] * SYMBOLS + coded[1:-1]) * SYMBOLS + coded[2:]
            total += np.bincount(code, minlength=SYMBOLS**3)
    seen = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(total[seen])], ["gram", "n"])


def character_model(docs: DataFrame, text_col: str = "text") -> CharacterModel:
    """The character model of all whole texts; its counts are 61^3 at most."""
    texts = docs.select(F.col(text_col).alias("text"))
    rows = texts.mapInArrow(_trigrams, "gram int, n bigint").groupBy("gram").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(SYMBOLS**3, np.int64)
    for gram, n in rows:
        counts[gram] = n
    return CharacterModel.of_counts(counts)


def restore_texts(docs: DataFrame, model: CharacterModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and restored text of every row; null texts are empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [restore(t or "", model) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id bigint, text string")


@dataclass(frozen=True)
class TermWeights:
    """Sorted term hashes and their log odds, with a bit table that most other hashes fail."""

    hashes: np.ndarray
    weights: np.ndarray

    def gate(self) -> np.ndarray:
        bits = np.zeros(1 << 20, bool)
        bits[(self.hashes & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
        return bits

    def features(self, coded: np.ndarray, bounds: np.ndarray, gate: np.ndarray) -> np.ndarray:
        """For each text: the three largest weights of different words, and the logarithms
        of how many words have a weight and of how many there are."""
        n = len(bounds) - 1
        text, whole, words, hashes = _terms(coded, bounds)
        weight = np.zeros(len(text), np.float32)
        if len(self.hashes):
            for has, h in zip(words, hashes):
                maybe = np.flatnonzero(gate[(h & np.uint64((1 << 20) - 1)).astype(np.int64)])
                at = np.minimum(np.searchsorted(self.hashes, h[maybe]), len(self.hashes) - 1)
                found = self.hashes[at] == h[maybe]
                np.maximum.at(weight, has[maybe[found]], self.weights[at[found]])
        out = np.zeros((n, 5), np.float64)
        hit = np.flatnonzero(weight > 0)
        if len(hit):
            _, first = np.unique(np.stack((text[hit].astype(np.uint64), whole[hit])), axis=1, return_index=True)
            hit = hit[first]
            order = hit[np.lexsort((-weight[hit], text[hit]))]
            place = np.arange(len(order)) - np.searchsorted(text[order], text[order])
            for k in range(3):
                top = order[place == k]
                out[text[top], k] = weight[top]
            out[:, 3] = np.log1p(np.bincount(text[hit], minlength=n))
        out[:, 4] = np.log1p(np.bincount(text, minlength=n))
        return out


@dataclass(frozen=True)
class ToxicityModel:
    """A character model, term weights, and a logistic function of a document's features."""

    characters: CharacterModel
    terms: TermWeights
    scale: np.ndarray
    coefficients: np.ndarray

    def scores(self, features: np.ndarray) -> np.ndarray:
        z = features / self.scale @ self.coefficients[:-1] + self.coefficients[-1]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _count_terms(model: CharacterModel):
    """(fold, term, toxic documents, other documents) of labelled texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fold, toxic = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("fold", "toxic"))
            for i, j, data, offsets in text_slices(batch, "text"):
                text, _, words, hashes = _terms(*_restored_symbols(data, offsets, model))
                doc = np.concatenate([text[w] for w in words]).astype(np.uint64)
                pairs = np.unique(np.stack((np.concatenate(hashes), doc)), axis=1)
                term, doc = pairs[0], pairs[1].astype(np.int64) + i
                kind = fold[doc] * 2 + toxic[doc]
                distinct, index = np.unique(term, return_inverse=True)
                counts = np.bincount(index * 4 + kind, minlength=len(distinct) * 4).reshape(-1, 4)
                for f in (0, 1):
                    some = np.flatnonzero(counts[:, 2 * f] + counts[:, 2 * f + 1])
                    columns = [pa.array(np.full(len(some), f, np.int32)), pa.array(distinct[some].view(np.int64)), pa.array(counts[some, 2 * f + 1]), pa.array(counts[some, 2 * f])]
                    yield pa.RecordBatch.from_arrays(columns, ["fold", "term", "pos", "neg"])

    return run


def _counts_in(folds: tuple[int, ...], docs: dict[tuple[int, int], int]) -> Column:
    """Whether a term may count when the labels of these folds weigh it; a little room is left for rounding."""
    pos_docs, neg_docs = (sum(docs.get((f, y), 0) for f in folds) for y in (1, 0))
    pos, neg = (reduce(lambda a, b: a + b, [F.col(f"{c}{f}") for f in folds]) for c in ("pos", "neg"))
    weight = F.log((pos + 0.5) / (pos_docs + 1)) - F.log((neg + 0.5) / (neg_docs + 1))
    return (pos >= TERM_DOCS) & (weight >= TERM_WEIGHT - 1e-9)


def _weigh(rows: list, folds: tuple[int, ...], docs: dict[tuple[int, int], int]) -> TermWeights:
    pos_docs, neg_docs = (sum(docs.get((f, y), 0) for f in folds) for y in (1, 0))
    if not rows:
        return TermWeights(np.zeros(0, np.uint64), np.zeros(0, np.float32))
    data = np.array(rows, np.int64)
    terms = np.ascontiguousarray(data[:, 0]).view(np.uint64)
    pos = sum(data[:, 1 + 2 * f] for f in folds)
    neg = sum(data[:, 2 + 2 * f] for f in folds)
    weight = np.log((pos + 0.5) / (pos_docs + 1)) - np.log((neg + 0.5) / (neg_docs + 1))
    good = (pos >= TERM_DOCS) & (weight >= TERM_WEIGHT)
    order = np.argsort(terms[good])
    return TermWeights(terms[good][order], weight[good][order].astype(np.float32))


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scale and coefficients of a ridge logistic regression, by Newton steps."""
    scale = np.maximum(np.abs(x).max(axis=0), 1e-9)
    a = np.column_stack((x / scale, np.ones(len(x))))
    beta = np.zeros(a.shape[1])
    ridge = np.full(a.shape[1], 1e-3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ beta, -30, 30)))
        gradient = a.T @ (y - p) - ridge * beta
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + np.diag(ridge), gradient)
        beta += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return scale, beta


def _features(terms: TermWeights, characters: CharacterModel, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gate = terms.gate()
        for batch in batches:
            for i, j, data, offsets in text_slices(batch, "text"):
                x = terms.features(*_restored_symbols(data, offsets, characters), gate)
                yield pa.RecordBatch.from_arrays([batch.column(c).slice(i, j - i) for c in keep] + [pa.array(list(x), pa.list_(pa.float64()))], [*keep, "x"])

    return run


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", train_rows: int = TRAIN_ROWS) -> ToxicityModel:
    """Fit on labelled documents: at most `train_rows` of them, by a hash of the id.

    The character model counts all whole texts of docs. Terms are weighed on all
    labelled rows taken; the logistic function is fitted on features of each half
    under the weights of the other half, so that a term seen by chance earns little.
    Several labels of one id count as the largest; null labels and ids are left out.
    Without labels of both kinds every score is the share of toxic labels.
    """
    characters = character_model(docs, text_col)
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("toxic")).dropna().groupBy("id").agg(F.max("toxic").alias("toxic"))
    taken = known.orderBy(F.xxhash64("id"), "id").limit(train_rows)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    fold = (F.pmod(F.xxhash64(F.col("id"), F.lit(1)), F.lit(2))).cast("int").alias("fold")
    # train_rows pairs of numbers at most
    train = texts.join(F.broadcast(taken), "id").select("id", fold, "toxic", "text")
    counted = train.mapInArrow(_count_terms(characters), "fold int, term bigint, pos bigint, neg bigint")
    by_term = counted.groupBy("term").agg(*[F.sum(F.when(F.col("fold") == f, F.col(c)).otherwise(0)).alias(f"{c}{f}") for f in (0, 1) for c in ("pos", "neg")])
    docs_by = {(r["fold"], r["toxic"]): r["n"] for r in train.groupBy("fold", "toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    # only terms that count in one half or both come here: each has TERM_DOCS of the train_rows documents
    counts = [_counts_in(folds, docs_by) for folds in ((0,), (1,), (0, 1))]
    table = by_term.where(reduce(lambda a, b: a | b, counts)).select("term", "pos0", "neg0", "pos1", "neg1").toArrow().to_pydict()
    rows = list(zip(*(table[c] for c in ("term", "pos0", "neg0", "pos1", "neg1"))))
    x: list = []
    y: list = []
    for own, other in ((0, 1), (1, 0)):
        half = train.where(F.col("fold") == own).mapInArrow(_features(_weigh(rows, (other,), docs_by), characters, ["toxic"]), "toxic int, x array<double>")
        for toxic, features in half.collect():
            x.append(features)
            y.append(toxic)
    if len(set(y)) < 2:
        share = min(max(sum(y) / len(y), 1e-6), 1 - 1e-6) if y else 1e-6
        return ToxicityModel(characters, _weigh([], (0, 1), docs_by), np.ones(5), np.array([0, 0, 0, 0, 0, np.log(share / (1 - share))]))
    scale, beta = _logistic(np.array(x), np.array(y, np.float64))
    return ToxicityModel(characters, _weigh(rows, (0, 1), docs_by), scale, beta)


def score(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score (0 to 1, higher: likelier toxic) of every row.

    A null text counts as empty; an empty text has the score of no evidence.
    Repeated rows and null ids keep a result each; columns beside id and text are
    not read; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gate = model.terms.gate()
        for batch in batches:
            for i, j, data, offsets in text_slices(batch, "text"):
                x = model.terms.features(*_restored_symbols(data, offsets, model.characters), gate)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), pa.array(model.scores(x))], ["doc_id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id bigint, score double")


def held_out(id_col: str = "doc_id"):
    """Whether a row's label is kept out of the fit: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def reject(docs: DataFrame, model: ToxicityModel, threshold: float = REJECT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without those that score `threshold` or more; all columns as they are. Rows
    that share an id go together; a row without an id stays, since nothing names it."""
    gone = score(docs, model, id_col, text_col).where(F.col("score") >= threshold).select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, docs[id_col] == gone["__gone"], "left_anti")
