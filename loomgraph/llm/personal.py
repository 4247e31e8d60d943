"""Operator 3: personal data by patterns and a character-level bidirectional LSTM with CRF transitions.

Base patterns find e-mail addresses, IP addresses, card and phone numbers. A tagger trained in numpy on labelled spans adds what
the patterns' fixed, greedy reading misses, such as a card number right behind other digits. The labelled spans are
the base spans in a sample of about MOST_WINDOWS windows of the corpus at most, from passages picked by a hash; windows in which two labelled
spans are set side by side are added to teach the tagger where one ends.

Texts are cut into overlapping windows of WINDOW characters. Each is decoded by Viterbi. The windows' spans are reconciled for the whole
text: of overlapping ones the one farthest from the edges of its window stays, spans that a window cuts are left to its
neighbours, every span must pass its kind's own test (a checksum, a count of digits), and base spans stay whatever the tagger says. As
every kind needs a digit or an @, windows with neither cannot add a span and aren't decoded, which changes nothing.

One pass without a shuffle, after the training, whose sample alone comes to the driver. Defined results: null and empty texts have
no spans; every row is judged by itself; without labelled spans there is no tagger and the base spans are all.
"""

from __future__ import annotations

import bisect
import hashlib
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.llm.crf import Tagger
from loomgraph.llm.texts import arrow_rows, free, slices
from loomgraph.session import table

KINDS = ("email", "ip", "card", "phone")
WINDOW, STRIDE = 96, 48
HIDDEN, EPOCHS, MOST_WINDOWS, SEED = 16, 12, 3000, 7
#: Characters of a passage of the training sample.
PASSAGE = 2048
#: Runs of digits begin where no digit stands before; a match cannot begin elsewhere.
LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
TRIGGER = "[0-9@]"

Span = tuple[int, int, int]


def digits(s: str) -> list[int]:
    return [ord(c) - 48 for c in s if "0" <= c <= "9"]


def passes(kind: int, s: str) -> bool:
    """The kind's own test of a whole span."""
    if kind == 0:
        at = s.find("@")
        return at > 0 and DOMAIN.fullmatch(s, at + 1) is not None and all(map(LOCAL.fullmatch, s[:at]))
    if kind == 1:
        parts = s.split(".")
        return len(parts) == 4 and all(p.isascii() and p.isdigit() and len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in parts)
    own = digits(s)
    if kind == 2:
        doubled = [d if k % 2 == 0 else 2 * d - 9 * (d > 4) for k, d in enumerate(reversed(own))]
        return 13 <= len(own) <= 19 and sum(doubled) % 10 == 0 and CARD.fullmatch(s) is not None
    return 9 <= len(own) <= 15


def base_spans(text: str) -> list[Span]:
    """(kind, start, end), by kind and start."""
    out: list[Span] = []
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and LOCAL.fullmatch(text, start - 1, start):
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            out.append((0, start, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    for kind, pattern in ((1, IP), (2, CARD), (3, PHONE)):
        out += [(kind, *m.span()) for m in pattern.finditer(text) if passes(kind, m.group())]
    return out


def classes() -> np.ndarray:
    """Classes of characters: the ASCII ones that matter by themselves, others in groups; 0 is the padding."""
    table = np.zeros(256, np.uint8)
    own = {c: i for i, c in enumerate("@.-_+%()\n ,:;='\"/#", 1)}
    for c in range(256):
        x = chr(c)
        table[c] = own.get(x) or (20 if x.isascii() and x.isdigit() else 21 if x.isascii() and x.islower() else 22 if x.isascii() and x.isupper() else 23 if x.isalpha() else 24)
    return table


CLASSES, SYMBOLS = classes(), 26


def symbols(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    return np.where(points < 256, CLASSES[np.minimum(points, 255)], 25).astype(np.uint8)


def allowed() -> np.ndarray:
    """Tags: 0 outside, 2k + 1 the first character of kind k, 2k + 2 a later one."""
    out = np.ones((2 * len(KINDS) + 1,) * 2, bool)
    for k in range(len(KINDS)):
        out[:, 2 * k + 2] = False
        out[[2 * k + 1, 2 * k + 2], 2 * k + 2] = True
    return out


def window_starts(own: np.ndarray) -> np.ndarray:
    """Starts of the windows that hold a digit or an @."""
    at = np.flatnonzero((own == 20) | (own == 1))
    if not at.size:
        return at
    last = at // STRIDE
    found = [last - k for k in range(WINDOW // STRIDE)]
    k = np.unique(np.concatenate(found))
    return k[k >= 0] * STRIDE


def cut(own: np.ndarray, starts: np.ndarray) -> np.ndarray:
    padded = np.append(own, np.zeros(WINDOW, np.uint8))
    return padded[starts[:, None] + np.arange(WINDOW)]


def tags_of(spans: list[Span], n: int) -> np.ndarray:
    out = np.zeros(n + WINDOW, np.uint8)
    for kind, a, b in reversed(spans):
        out[a] = 2 * kind + 1
        out[a + 1 : b] = 2 * kind + 2
    return out


def reconciled(tags: np.ndarray, starts: np.ndarray, text: str, base: list[Span]) -> list[Span]:
    """The spans of all windows of a text, base spans included."""
    n, found = len(text), []
    for s, row in zip(starts.tolist(), tags, strict=True):
        for a in np.flatnonzero(row % 2 == 1).tolist():
            inner = row[a] + 1
            b = a + 1
            while b < WINDOW and row[b] == inner:
                b += 1
            if (a == 0 and s > 0) or (b == WINDOW and s + WINDOW < n) or s + b > n:
                continue  # cut by its window
            margin = min(a if s else WINDOW, WINDOW - b if s + WINDOW < n else WINDOW)
            if passes(kind := int(row[a]) // 2, text[s + a : s + b]):
                found.append((-margin, s + a, s + b, kind))
    # Accepted spans of the tagger don't overlap each other, nor the base spans' union, so neighbours in order are enough.
    taken: list[tuple[int, int]] = []
    for a, b in sorted((a, b) for _, a, b in base):
        if taken and a < taken[-1][1]:
            taken[-1] = taken[-1][0], max(b, taken[-1][1])
        else:
            taken.append((a, b))
    # A candidate overlaps few others, as a window has few spans: each is held against those by place.
    rank = {x: i for i, x in enumerate(sorted(set(found)))}
    chosen, kept = sorted(rank, key=lambda x: x[1:]), set()
    starts, ends = [x for x, _ in taken], [y for _, y in taken]
    open_ = [x for x in chosen if not (k := bisect.bisect_left(ends, x[1] + 1)) < len(starts) or starts[k] >= x[2]]
    widest = max((b - a for _, a, b, _ in open_), default=0)
    places = [x[1] for x in open_]
    for x in sorted(open_, key=rank.get):
        lo, hi = bisect.bisect_left(places, x[1] - widest), bisect.bisect_left(places, x[2])
        if not any(k in kept and open_[k][2] > x[1] for k in range(lo, hi)):
            kept.add(bisect.bisect_left(open_, x[1:], key=lambda y: y[1:]))
    return sorted([*base, *((open_[k][3], open_[k][1], open_[k][2]) for k in kept)])


def sample(df: DataFrame, key: str, text: str, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows and their tags from passages picked by a hash of what the row holds and of the place, so that neither a very long text nor repeated keys come whole and the same rows give the same sample however they are dealt to tasks; equal rows count once."""
    rows = df.select(F.xxhash64(key, text).alias("h"), F.col(text).alias("text")).where(F.col("text").rlike(TRIGGER))
    # About as many windows as a text has with a trigger: each trigger lies in WINDOW / STRIDE, which hold some dozen where they hold any, and there are no more than its length allows.
    triggers, length = F.char_length(F.regexp_replace("text", "[^0-9@]+", "")), F.char_length("text")
    sizes = rows.groupBy("h").agg(F.max(F.least(triggers * WINDOW / STRIDE / 12, length / STRIDE) + 1).alias("n"))
    rate = min(1.0, most / ((sizes.agg(F.sum("n")).first()[0] or 0) + 1))
    last = F.floor((F.char_length("text") - 1) / PASSAGE).cast("int")
    drawn = F.filter(F.sequence(F.lit(0), last), lambda k: F.shiftrightunsigned(F.xxhash64("h", k), 11) / float(1 << 53) < rate)
    rows = rows.select("h", "text", F.explode(drawn).alias("k")).dropDuplicates(["h", "k"]).select(F.col("text").substr(F.col("k") * PASSAGE + 1, F.lit(PASSAGE)).alias("text")).where(F.col("text").rlike(TRIGGER))

    def windows(batches):
        for whole in batches:
            for batch in slices(whole, "text"):
                for t in batch.column("text").to_pylist():
                    own = symbols(t)
                    starts = window_starts(own)
                    tags = tags_of(base_spans(t), len(t))
                    for s in starts.tolist():
                        yield pa.RecordBatch.from_pydict({"x": pa.array([cut(own, np.array([s]))[0].tobytes()], pa.binary()), "y": pa.array([tags[s : s + WINDOW].tobytes()], pa.binary())})

    arrow_rows(df.sparkSession)
    found = sorted({(bytes(r.x), bytes(r.y)) for r in rows.select("text").mapInArrow(windows, "x binary, y binary").collect()})
    keep = np.linspace(0, len(found) - 1, most).astype(int) if len(found) > most else range(len(found))
    x, y = (np.frombuffer(b"".join(found[i][k] for i in keep), np.uint8).reshape(-1, WINDOW) for k in range(2))
    return x.copy(), y.copy()


def side_by_side(x: np.ndarray, y: np.ndarray, n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """n windows in which two labelled spans follow each other behind a blank."""
    spans = []
    for row, tags in zip(x, y, strict=True):
        for a in np.flatnonzero(tags % 2 == 1):
            b = a + 1
            while b < WINDOW and tags[b] == tags[a] + 1:
                b += 1
            if b < WINDOW and b - a < 40:
                spans.append((row[a:b], tags[a:b]))
    rng, blank = np.random.default_rng(seed), np.array([CLASSES[32]], np.uint8)
    out_x, out_y = [], []
    for _ in range(n if spans else 0):
        (p, q), host = rng.integers(len(spans), size=2), int(rng.integers(len(x)))
        own = np.concatenate([blank, spans[p][0], blank, spans[q][0], blank])
        tags = np.concatenate([[0], spans[p][1], [0], spans[q][1], [0]]).astype(np.uint8)
        at = int(rng.integers(WINDOW - own.size + 1))
        hx, hy = x[host].copy(), y[host].copy()
        hx[at : at + own.size], hy[at : at + own.size] = own, tags
        before, after = hy[at - 1] if at else 0, at + own.size
        if at and before and (hy[at - 1] or y[host][at]):  # what the insertion cuts in two is no span any more
            k = at - 1
            while k > 0 and hy[k] % 2 == 0 and hy[k]:
                k -= 1
            hy[k:at] = 0
        while after < WINDOW and hy[after] and hy[after] % 2 == 0:
            hy[after] = 0
            after += 1
        out_x.append(hx), out_y.append(hy)
    return (np.array(out_x), np.array(out_y)) if out_x else (x[:0], y[:0])


def train(df: DataFrame, key: str = "doc_id", text: str = "text", most: int = MOST_WINDOWS, hidden: int = HIDDEN, epochs: int = EPOCHS, seed: int = SEED) -> Tagger | None:
    """A tagger from df's base spans; None if its sample has none."""
    x, y = sample(df, key, text, most)
    if not len(x) or not y.any():
        return None
    more = side_by_side(x, y, len(x) // 2, seed)
    x, y = np.concatenate([x, more[0]]), np.concatenate([y, more[1]]).astype(np.int64)
    tagger = Tagger.new(SYMBOLS, hidden, allowed(), seed)
    tagger.train(x, y, epochs, seed=seed)
    return tagger


def spans_of(texts: list[str | None], tagger: Tagger | None, step: int = 1024) -> list[tuple[list[Span], list[Span]]]:
    """(base spans, all spans) of each text. All texts' windows are decoded together."""
    own = [symbols(t or "") for t in texts]
    starts = [window_starts(s) if tagger else np.zeros(0, np.int64) for s in own]
    base = [base_spans(t or "") for t in texts]
    if not tagger or not sum(s.size for s in starts):
        return [(b, b) for b in base]
    x = np.concatenate([cut(o, s) for o, s in zip(own, starts, strict=True) if s.size])
    distinct, back = np.unique(x, axis=0, return_inverse=True)
    tags = np.concatenate([tagger.decode(distinct[lo : lo + step]) for lo in range(0, len(distinct), step)])[back.ravel()]
    out, k = [], 0
    for t, s, b in zip(texts, starts, base, strict=True):
        out.append((b, reconciled(tags[k : k + s.size], s, t or "", b) if s.size else b))
        k += s.size
    return out


def written(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def per_text(df: DataFrame, tagger: Tagger | None, text: str, keep: list[str], fields: list[T.StructField], make) -> DataFrame:
    """keep, then the columns that make(texts, spans) gives; texts without a digit or an @ have no spans."""

    def run(batches):
        for whole in batches:
            for batch in slices(whole, text):
                some = pc.fill_null(pc.match_substring_regex(batch.column(text), TRIGGER), False).to_numpy(zero_copy_only=False)
                texts = batch.column(text).to_pylist()
                at = np.flatnonzero(some).tolist()
                spans: list[tuple[list[Span], list[Span]]] = [([], [])] * len(texts)
                for i, s in zip(at, spans_of([texts[i] for i in at], tagger), strict=True):
                    spans[i] = s
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *make(texts, spans)], [*keep, *(f.name for f in fields)])

    arrow_rows(df.sparkSession)
    return df.mapInArrow(run, T.StructType([*(df.schema[c] for c in keep), *fields]))


def find(df: DataFrame, tagger: Tagger | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, the base counts, base_sha256 and all spans as text."""

    def make(texts, spans):
        none = hashlib.sha256(b"").hexdigest()
        counts = [pa.array([sum(s[0] == k for s in base) for base, _ in spans], pa.int64()) for k in range(len(KINDS))]
        return [*counts, pa.array([hashlib.sha256(written(b).encode()).hexdigest() if b else none for b, _ in spans]), pa.array([written(a) for _, a in spans], pa.string())]

    fields = [*(T.StructField(f"n_{k}", T.LongType()) for k in KINDS), T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())]
    own = df.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    return per_text(own, tagger, "_text", ["_key"], fields, make).withColumnRenamed("_key", key)


def masked(text: str, spans: list[Span]) -> str:
    """The text with each span, or union of overlapping ones, replaced by its first kind in angle brackets."""
    out, done = [], 0
    merged: list[list] = []
    for k, a, b in sorted(spans, key=lambda s: (s[1], -s[2], s[0])):
        if merged and a < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], b)
        else:
            merged.append([k, a, b])
    for k, a, b in merged:
        out += [text[done:a], f"<{KINDS[k]}>"]
        done = b
    return "".join([*out, text[done:]])


def cleaned(text: str, spans: list[Span]) -> str:
    """The text masked, again where what is left of a run of digits is personal data by itself."""
    while spans:
        text = masked(text, spans)
        spans = base_spans(text)
    return text


def mask(df: DataFrame, tagger: Tagger | None, text: str = "text") -> DataFrame:
    """df with its spans masked, in the same columns and order; nulls stay."""

    def make(texts, spans):
        return [pa.array([t if t is None or not s else cleaned(t, s) for t, (_, s) in zip(texts, spans, strict=True)], pa.string())]

    name = free("masked", df.columns)
    field = T.StructField(name, T.StringType())
    made = per_text(df, tagger, text, df.columns, [field], make)
    return made.select(*[F.col(name).alias(c) if c == text else F.col(c) for c in df.columns])


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return find(docs, train(docs))
