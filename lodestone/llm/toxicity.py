"""Toxicity scores of deobfuscated text.

A character trigram model is counted over the whole corpus. Pieces of text that look
disguised (digits and symbols among letters, letters run out, letters set apart by
spaces or marks) become lattices of what each character may stand for; Viterbi decoding
under the character model and a channel cost restores them. The restored words are then
scored: word beginnings that the labelled sample separates, by rate, in a logistic
regression. Labels are fitted on a bounded sample of labelled rows; the character model
counts all rows. The sampled texts stay on the executors, which restore them, count their
word beginnings and choose those that separate the labels; the driver gets numbers of
the chosen ones and takes the Newton steps.

Defined cases: a null or empty text scores as a text without features; tables without
labels of both kinds give every row the share of label 1 seen (0 without labels);
repeated label rows of a document count once, as the larger; labels without document,
null labels and rows without label are not fitted; extra columns play no part. Texts of
any length are restored and scored whole.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from . import cluster, text

SAMPLE = 2000  # labelled rows of each kind that are fitted, at most
FEATURES = 400
_LETTERS = 28  # a boundary, a to z, any other letter
_BATCH = 1000

# What a disguising character may stand for.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i",
}
SUBSTITUTED, DROPPED, DOUBLED, COLLAPSED, JOINED = 2.0, 9.0, 1.5, 0.5, 0.5  # channel costs, in nats
NUMBER, PUNCTUATION = 4.0, 0.0  # cost of dropping a digit or a mark that ends a word, which mostly is just that

_SYMBOLS = re.escape("".join(LEET))
_WORD = re.compile(r"[^\W\d_]+")
#: What makes a token suspect: symbols among or before letters, a letter run out, marks between letters.
_SUSPECT = re.compile(rf"[^\W\d_][{_SYMBOLS}]+[^\W\d_]|^[{_SYMBOLS}]+[^\W\d_]|([^\W\d_])\1\1|[^\W\d_][*_~][^\W\d_]|^[^\W\d_](?:[.-][^\W\d_]){{2,}}$|[^\W\d_][{_SYMBOLS}]+$")
_SINGLE = rf"(?:[^\W\d_]|[{_SYMBOLS}])"
_SPACED = re.compile(rf"(?<!\S){_SINGLE}(?:\s+{_SINGLE}){{2,}}(?!\S)")
_APART = re.compile(rf"[^\W\d_][ .*_~-][^\W\d_](?:[ .*_~-][^\W\d_])+$|{_SINGLE} {{1,2}}{_SINGLE}(?: {{1,2}}{_SINGLE})+$")


def _code_table() -> np.ndarray:
    """By byte: 0 boundary, 1 to 26 letters, 27 the first byte of another character, 255 the rest of one."""
    t = np.zeros(256, np.uint8)
    t[0x41:0x5B] = t[0x61:0x7B] = np.arange(1, 27)
    t[0x80:0xC0] = 255
    t[0xC0:] = 27
    return t


_CODES = _code_table()


def trigram_counts(docs: DataFrame, text_column: str = "text") -> np.ndarray:
    """Counts of three successive letters over all texts, boundaries collapsed; one array a task meets in slices."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(_LETTERS**3, np.int64)
        for batch in it:
            data, off = text.utf8(batch.column(0))
            for lo in range(0, len(off) - 1, 256):
                part = off[lo : lo + 257]
                c = _CODES[data[part[0] : part[-1]]]
                c = np.insert(c, part[:-1] - part[0], 0)
                c = c[c != 255]
                keep = np.ones(len(c), bool)
                keep[1:] = (c[1:] != 0) | (c[:-1] != 0)
                c = np.append(c[keep], [0, 0]).astype(np.int32)
                total += np.bincount((c[:-2] * _LETTERS + c[1:-1]) * _LETTERS + c[2:], minlength=_LETTERS**3)
        yield pa.RecordBatch.from_arrays([pa.array(range(_LETTERS), pa.int32()), pa.array(total.reshape(_LETTERS, -1).tolist(), pa.list_(pa.int64()))], ["part", "n"])

    def add(table: pa.Table) -> pa.Table:
        n = np.array(table.column("n").to_pylist(), np.int64).sum(0)
        return pa.table({"part": table.column("part")[:1], "n": pa.array([n.tolist()], pa.list_(pa.int64()))})

    kind = "part int, n array<long>"
    out = np.zeros((_LETTERS, _LETTERS**2), np.int64)
    for r in docs.select(F.col(text_column).cast("string").alias("text")).mapInArrow(run, kind).groupBy("part").applyInArrow(add, kind).collect():
        out[r["part"]] = r["n"]  # 28 rows of 784 counts
    return out.ravel()


class CharModel:
    """Interpolated log probabilities of a letter after two others."""

    def __init__(self, counts: np.ndarray):
        three = counts.reshape(_LETTERS, _LETTERS, _LETTERS).astype(np.float64)
        two, one = three.sum(0), three.sum((0, 1))
        p1 = (one + 1) / (one.sum() + _LETTERS)
        p2 = (two + 2 * p1) / (two.sum(1, keepdims=True) + 2)
        p3 = (three + 2 * p2[None]) / (three.sum(2, keepdims=True) + 2)
        self.log = np.log(p3).tolist()


def _code(c: str) -> int:
    return ord(c) - 96 if "a" <= c <= "z" else 27


def lattice(piece: str) -> list[list[tuple[str, float]]]:
    """For each place of a lower-case piece: the letters it may stand for, with their costs."""
    places: list[list[tuple[str, float]]] = []
    i, spaced = 0, bool(_APART.match(piece))
    ends = len(piece) if spaced else len(piece.rstrip("".join(LEET)))  # where the symbols that end a word begin
    plain = ends < len(piece) and not ({"$", "@"} & set(piece[ends:]) or _SUSPECT.search(piece[:ends]))  # nothing but its end is suspect
    while i < len(piece):
        c = piece[i]
        n = 1
        while i + n < len(piece) and piece[i + n] == c:
            n += 1
        if c in LEET:
            drop = DROPPED if i < ends or c in "$@" else NUMBER if c.isdigit() else PUNCTUATION
            one = [(x, SUBSTITUTED) for x in LEET[c]] + [("", drop)]
            places += [one] * (1 if n == 1 else 2)
            if n > 1:
                places[-1] = [*one[:-1], ("", COLLAPSED)]
        elif c in " .*_~-":
            places.append([("", JOINED if spaced else SUBSTITUTED), (" ", DROPPED if spaced and n == 1 else 0.0)])
        elif not c.isalpha():
            places.append([("", DROPPED)])
        elif n == 1:
            places.append([(c, 0.0)])
        elif n == 2:
            places.append([(c + c, 0.0)] if plain else [(c + c, 0.0), (c, DOUBLED)])
        else:
            places.append([(c, COLLAPSED), (c + c, DOUBLED)])
        i += n
    return places


def decode(piece: str, model: CharModel) -> str:
    """The most probable restoration of a piece: Viterbi over its lattice, states being the last two letters."""
    log = model.log
    states: dict[tuple[int, int], tuple[float, tuple]] = {(0, 0): (0.0, ())}  # score and path: letters, the path before
    for options in lattice(piece.lower()):
        new: dict[tuple[int, int], tuple[float, tuple]] = {}
        for (a, b), (score, path) in states.items():
            for letters, cost in options:
                x, y, s = a, b, score - cost
                for c in letters:
                    k = 0 if c == " " else _code(c)
                    s += log[x][y][k]
                    x, y = y, k
                if (x, y) not in new or new[x, y][0] < s:
                    new[x, y] = (s, (letters, path))
        states = new
    path = max(((s + log[a][b][0], a, b, path) for (a, b), (s, path) in states.items()), key=lambda x: x[:3])[3]
    out = []
    while path:
        letters, path = path
        out.append(letters)
    return "".join(reversed(out))


def trimmed(token: str) -> str:
    """A token without what no disguise ends in: from the first mark on that is no symbol, or three symbols on."""
    end = len(token)
    while end and not (token[end - 1].isalnum() or token[end - 1] == "_"):
        end -= 1
    for i in range(end, min(len(token), end + 3)):
        if token[i] not in LEET or (i + 3 <= len(token) and all(c in LEET for c in token[i : i + 3])):
            return token[:i]
    return token


def restored_words(token: str, model: CharModel) -> list[str]:
    """The words of a lower-case token without white space, decoded where it is suspect."""
    if not token.isalpha():
        token = trimmed(token)
    return _WORD.findall(decode(token, model) if _SUSPECT.search(token) else token)


def tokens_of(body: str, model: CharModel) -> list[str]:
    """Lower-case tokens; letters and their symbols set apart by white space are decoded together."""
    body = body.lower()
    tokens = body.split()
    if sum(map(_single, tokens)) >= 3:
        tokens = _SPACED.sub(lambda m: _together(m[0], model), body).split()
    return tokens


def _together(run: str, model: CharModel) -> str:
    """A run of single characters, decoded if it has letters; gaps wider than its least may part words."""
    if not any(map(str.isalpha, run)):
        return run
    gaps = re.findall(r"\s+", run)
    least = min(map(len, gaps))
    return decode("".join(c + (" " if len(g) == least else "  ") for c, g in zip(run.split(), gaps)) + run[-1], model)


def _single(token: str) -> bool:
    return len(token) == 1


def beginnings(word: str) -> list[str]:
    """The word itself and its beginnings of 3 to 8 letters."""
    return [word + "$", *(word[:n] for n in range(3, min(len(word), 8) + 1))]


class _Features(dict):
    """Word count and features of tokens, kept from the second time on while there is room: most come up once."""

    def __init__(self, features: dict[str, int], model: CharModel):
        self.features, self.model = features, model
        self.seen = bytearray(1 << 22)

    def __missing__(self, token: str) -> tuple[int, tuple[int, ...]]:
        words, get = restored_words(token, self.model), self.features.get
        out = len(words), tuple([k for w in words for k in map(get, beginnings(w)) if k is not None])
        if len(self) < 300_000:
            at = hash(token) & 0x3FFFFF
            if self.seen[at]:
                self[token] = out
            else:
                self.seen[at] = 1
        return out


@dataclass
class Scorer:
    """A fitted model: character counts, features, weights."""

    counts: np.ndarray
    features: dict[str, int] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bias: float = 0.0
    constant: float | None = None

    def __post_init__(self) -> None:
        self.model = CharModel(self.counts)
        self.known = _Features(self.features, self.model)

    def __getstate__(self) -> dict:
        return {k: getattr(self, k) for k in ("counts", "features", "weights", "bias", "constant")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.__post_init__()

    def score(self, body: str | None) -> float:
        if self.constant is not None:
            return self.constant
        z = self.bias
        if body:
            found = list(map(self.known.__getitem__, tokens_of(body, self.model)))
            hits = [f[1] for f in found if f[1]]
            if hits:
                per = 1000.0 / sum([f[0] for f in found])
                for k, n in Counter([i for f in hits for i in f]).items():
                    z += self.weights[k] * math.log1p(per * n)
        return 1.0 / (1.0 + math.exp(-max(-700.0, min(700.0, z))))


def _rates(body: str | None, model: CharModel) -> dict[str, float]:
    """By word beginning: the logarithm of its rate in a thousand restored words."""
    n: Counter = Counter()
    total = 0
    for token, k in Counter(tokens_of(body or "", model)).items():
        words = restored_words(token, model)
        total += k * len(words)
        for w in words:
            for b in beginnings(w):
                n[b] += k
    per = 1000.0 / max(1, total)
    return {b: math.log1p(per * k) for b, k in n.items()}


UNIT = 1 << 20  # rates are whole numbers of these parts, so that their sums don't depend on their order


def sample_rates(sample: DataFrame, counts: np.ndarray) -> DataFrame:
    """(doc_id, y, names, rates): the word beginnings of each restored text; sample: (doc_id, y, body)."""
    shared = sample.sparkSession.sparkContext.broadcast(counts)  # 28 ** 3 numbers

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = CharModel(shared.value)
        for batch in cluster.batches(it, 50):
            found = [_rates(body, model) for body in batch.column(2).to_pylist()]
            names = pa.array([list(f) for f in found], pa.list_(pa.string()))
            rates = pa.array([[round(x * UNIT) for x in f.values()] for f in found], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), names, rates], ["doc_id", "y", "names", "rates"])

    return sample.select("doc_id", "y", "body").mapInArrow(run, "doc_id long, y int, names array<string>, rates array<long>")


def choose_features(rates: DataFrame, n: dict[int, int], most: int = FEATURES) -> list[str]:
    """The word beginnings whose mean rates differ most between the labels, in units of their spread."""
    pairs = rates.select("y", F.explode(F.arrays_zip("names", "rates")).alias("p")).select("y", F.col("p.names").alias("name"), F.col("p.rates").alias("r"))
    of = lambda y, x: F.sum(F.when(F.col("y") == y, x).otherwise(F.lit(0)))
    r = F.col("r")
    sums = pairs.groupBy("name").agg(of(1, F.lit(1)).alias("seen"), of(1, r).alias("s1"), of(1, r * r).alias("q1"), of(0, r).alias("s0"), of(0, r * r).alias("q0"))
    sums = sums.filter(F.col("seen") >= max(3, int(0.01 * n[1])))
    mean = lambda y: F.col(f"s{y}") / (UNIT * n[y])
    spread = lambda y: F.greatest(F.col(f"q{y}") / (float(UNIT) ** 2 * n[y]) - mean(y) * mean(y), F.lit(0.0)) / n[y]
    score = (mean(1) - mean(0)) / F.sqrt(spread(1) + spread(0) + 1e-6)
    return [x["name"] for x in sums.select("name", score.alias("score")).orderBy(F.desc("score"), "name").limit(most).collect()]


def fit(rates: DataFrame, n: dict[int, int], total: dict[int, int], counts: np.ndarray) -> Scorer:
    """A scorer from the rates of n rows of each label, which stand for a total of each."""
    if not n.get(0) or not n.get(1):
        return Scorer(counts, constant=1.0 if n.get(1) else 0.0)
    names = choose_features(rates, n)
    features = {name: k for k, name in enumerate(names)}

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            at, value = [], []
            for words, r in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                have = [(features[w], x / UNIT) for w, x in zip(words, r) if w in features]
                at.append([k for k, _ in have])
                value.append([x for _, x in have])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(at, pa.list_(pa.int32())), pa.array(value, pa.list_(pa.float64()))], ["doc_id", "y", "at", "value"])

    rows = sorted(rates.mapInArrow(run, "doc_id long, y int, at array<int>, value array<double>").collect(), key=lambda r: r["doc_id"])  # at most 2 * SAMPLE
    y = np.array([float(r["y"]) for r in rows])
    x = np.zeros((len(y), len(names) + 1))
    x[:, -1] = 1
    for i, r in enumerate(rows):
        x[i, r["at"]] = r["value"]
    weight = np.where(y > 0, total[1] / n[1], total[0] / n[0])
    weight /= weight.mean()
    w = np.zeros(x.shape[1])
    ridge = np.full(len(w), 1.0)
    ridge[-1] = 1e-3
    for _ in range(30):  # Newton steps
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (weight * (p - y)) + ridge * w
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(ridge), gradient)
        w -= step * min(1.0, 5.0 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-6:
            break
    return Scorer(counts, features, w[:-1], float(w[-1]))


def held_out(id_column: str = "doc_id", folds: int = 5) -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit("")).cast("binary")), F.lit(folds)) == 0


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_column: str = "doc_id", text_column: str = "text", label_column: str = "toxic") -> Scorer:
    """A scorer from the labelled documents outside the held-out fold, at most ``sample`` of each label."""
    rows = cluster.by_position(docs).select(cluster.at(docs, id_column).alias("doc_id"), cluster.at(docs, text_column).cast("string").alias("body"))
    counts = trigram_counts(rows, "body")
    known = labels.filter(F.col(label_column).isNotNull() & F.col(id_column).isNotNull() & ~held_out(id_column)).groupBy(F.col(id_column).alias("doc_id")).agg((F.max(label_column) > 0).cast("int").alias("y"))
    total = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    chosen = None
    for y in (0, 1):
        part = known.filter(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
        chosen = part if chosen is None else chosen.unionByName(part)
    # At most 2 * sample ids are broadcast; of a document that is there several times one text is fitted.
    texts = rows.join(F.broadcast(chosen), "doc_id").groupBy(F.col("doc_id").cast("long").alias("doc_id"), "y").agg(F.min("body").alias("body"))
    rates = cluster.saved(sample_rates(texts.repartition(cluster.partitions(docs.sparkSession)), counts), "rates")
    n = {r["y"]: r["count"] for r in rates.groupBy("y").count().collect()}
    return fit(rates, n, total, counts)


def scores(docs: DataFrame, scorer: Scorer, text_column: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` and ``score`` of each row."""
    keep = ["doc_id"] if keep is None else keep
    shared = docs.sparkSession.sparkContext.broadcast(scorer)  # 28 ** 3 counts and FEATURES weights
    rows = cluster.by_position(docs).select(cluster.at(docs, text_column).cast("string").alias("body"), *(cluster.at(docs, k).alias(f"k{i}") for i, k in enumerate(keep)))
    fields = rows.schema.fields[1:]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in cluster.batches(it, _BATCH):
            out = [model.score(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(out, pa.float64())], [*(f.name for f in fields), "score"])

    return rows.mapInArrow(run, StructType([*fields, StructField("score", DoubleType())])).toDF(*keep, "score")


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, text_column: str = "text") -> DataFrame:
    """The rows of ``docs`` that score below the threshold, all their columns."""
    scorer = train(docs, labels, text_column=text_column)
    names = [f"c{i}" for i in range(len(docs.columns))]  # a column of the rows may be named as ours
    scored = scores(docs.toDF(*names), scorer, names[docs.columns.index(text_column)], names)
    return scored.filter(F.col("score") < threshold).select(*names).toDF(*docs.columns)
