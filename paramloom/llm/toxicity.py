"""Toxicity by weak supervision.

Voters are lexicons, text patterns, and word stems mined from a bounded sample of labelled rows. A generative label
model is fitted to how often voters fire, and fire together, over ALL documents: under a hidden class the covariance
of independent voters is a product a_i * a_j, so a rank-one fit gives each voter's accuracies and what it leaves
gives the pairs that are correlated beyond the class; those are discounted. A given label is one more voter: its
accuracy comes from the same fit (over the labelled rows of the sample), and it abstains elsewhere. The posterior
labels of a bounded sample of labelled documents outside the held-out fold then train a linear classifier on words, word
prefixes and how many words of a text share a prefix; it scores every whole text. Without labels the path is the same,
with lexicons and patterns as the only voters and a sample of all documents outside the fold.

Defined cases: null text is the empty text and gets the classifier's base score; documents without labels are scored
like all others; where no voter fires the lexicons' words keep a weight of their own; rows that repeat a doc_id are
scored each, and train once if their texts are equal; a doc_id with contrary labels counts once with each; other columns, of whatever name, play no part; an
empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Collection, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import discard, few, materialize

#: Bound of the training sample: labelled rows (stems are mined from them as well); any rows where no label is given.
SAMPLE_ROWS = 20_000
#: Feature slots, the most features kept, and the evidence (nats) a feature needs against chance.
SLOTS, MOST_FEATURES, EVIDENCE = 1 << 22, 3000, 10.0
#: Bounds of a worker's memory: words remembered, and slots of texts held before their sums are put out.
KNOWN_WORDS, HELD_SLOTS = 100_000, 1_000_000
#: the strongest stems mined from labelled rows, each a voter, and the share of the class they need among rows with them
MINED_VOTERS, PURE = 40, 0.9
#: share of the class where no labels tell it, and the accuracy below which pairs of voters tell too little
PRIOR, LEAST_ACCURACY = 0.1, 0.3
FOLDS, HELD_OUT = 5, 0

LEXICONS = {
    "intellect": "idiot idiots idiotic moron morons moronic stupid stupidity dumb dumbass imbecile cretin fool foolish clown clowns dimwit halfwit brainless",
    "worth": "worthless pathetic loser losers useless trash garbage scum scumbag lowlife nobody failure",
    "disgust": "disgusting vile filthy filth repulsive gross nasty pig pigs rat vermin parasite parasites",
    "abuse": "bastard bitch bitches asshole jerk prick dick cunt whore slut fuck fucking fucker shit shitty crap damn",
    "threat": "kill die hang shoot stab strangle murder destroy",
    "german": "idioten dumm dummkopf blöd blödmann arschloch scheiße scheisse wertlos abschaum versager hurensohn trottel depp widerlich ekelhaft",
    "french": "idiote imbécile connard connasse salaud salope merde stupide débile abruti crétin minable ordure pourri dégoûtant",
    "spanish": "idiotas imbécil estúpido estúpida tonto tonta gilipollas cabrón mierda puta basura inútil asqueroso patético escoria",
}
_OF_WORD = {w: k for k, words in enumerate(LEXICONS.values()) for w in words.split()}
_PATTERNS = (
    re.compile(r"\b(?:you|your|you're|u r)\b[^.\n]{0,20}\b(?:idiot|moron|stupid|pathetic|loser|trash|scum|clown|worthless|disgusting)"),
    re.compile(r"\b(?:kill|hurt|find) (?:you|yourself|them all)\b"),
    re.compile(r"!{3,}"),
)
#: strings that a text needs for the first two patterns to match
_NEEDED = (("idiot", "moron", "stupid", "pathetic", "loser", "trash", "scum", "clown", "worthless", "disgusting"), ("kill ", "hurt ", "find "))
_LETTERS = re.compile(r"[^\W\d_]+")
PREFIXES = (3, 4, 5, 6, 7, 8)
#: how many different words of a prefix make a feature of their own: one may be chance, three are a habit
LEVELS = (2, 3, 5)


def slots(word: str) -> list[int]:
    """Feature slots of a lower-case word: itself and its prefixes."""
    found = [zlib.crc32(b"=" + word.encode("utf-8", "surrogatepass"))]
    found += [zlib.crc32(word[:n].encode("utf-8", "surrogatepass")) for n in PREFIXES if len(word) >= n]
    return [x & (SLOTS - 1) for x in found]


def at_level(slot, level: int):
    """The slot (or array of slots) of `level` different words of a text that share a slot: behind all plain ones."""
    return slot + SLOTS * (1 + LEVELS.index(level))


def remainder() -> Column:
    """crc32 of doc_id as text, modulo the folds."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS))


class _Words(dict):
    """Word -> its slots that a table knows, and those it knows at a level; remembered for frequent words."""

    def __init__(self, table: Collection[int]) -> None:
        super().__init__()
        self.table = table
        self.counted = {s % SLOTS for s in table if s >= SLOTS}

    def look(self, word: str) -> tuple[tuple[int, ...], tuple[int, ...]] | None:
        own = slots(word)
        plain = tuple([s for s in own if s in self.table])
        counted = tuple([s for s in own if s in self.counted]) if self.counted else ()
        return (plain, counted) if plain or counted else None

    def __missing__(self, word: str):
        found = self.look(word)
        if len(self) > KNOWN_WORDS:
            self.clear()
        self[word] = found
        return found

    def of(self, low: str) -> set[int]:
        """What the words of a lower-case text have in the table."""
        hits: set[int] = set()
        times: dict[int, int] = {}
        for plain, counted in filter(None, map(self.__getitem__, set(_LETTERS.findall(low)))):
            hits.update(plain)
            for s in counted:
                times[s] = times.get(s, 0) + 1
        for s, n in times.items():
            hits.update(x for k in LEVELS if n >= k and (x := at_level(s, k)) in self.table)
        return hits


class _Votes(_Words):
    """Votes of a text: its lexicons (but for quiet words), patterns, and the mined stems it has (slot -> voter)."""

    def __init__(self, table: dict[int, int], quiet: frozenset[str] = frozenset()) -> None:
        super().__init__(table)
        self.quiet = quiet

    def look(self, word: str):
        found = super().look(word)
        k = None if word in self.quiet else _OF_WORD.get(word)
        if k is None:
            return found
        plain, counted = found or ((), ())
        return (*plain, -1 - k), counted  # below zero: a lexicon

    def mask(self, low: str) -> int:
        """Bit mask of the voters that fire on a lower-case text."""
        mask = 0
        for s in self.of(low):
            mask |= 1 << (-1 - s if s < 0 else self.table[s])
        for k, pattern in enumerate(_PATTERNS):
            if "!!!" in low if k == 2 else any(map(low.__contains__, _NEEDED[k])):
                if pattern.search(low):
                    mask |= 1 << (len(LEXICONS) + k)
        return mask


def _evidence(at: np.ndarray, bad: np.ndarray, good: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(bad, pa.float64()), pa.array(good, pa.float64())], ["slot", "bad", "good"])


def _mine(sample: DataFrame, weigh: Callable[[str, bool | None], float]) -> tuple[list[tuple[int, float, float]], float, float, frozenset[str]]:
    """Slots with clear evidence for the class, strongest first, with the weights of rows for and against it that have
    them; the weights of all rows; and the lexicons' words that stand against it more than for it (in other languages
    such words mean something else)."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, bytes] = {}
        n, held, shares, size = [0.0, 0.0], [], [], 0

        def sums() -> Iterator[pa.RecordBatch]:
            at, place = np.unique(np.concatenate(held), return_inverse=True)
            share = np.repeat(shares, [len(x) for x in held])
            bad, good = np.bincount(place, share), np.bincount(place, 1 - share)
            for k in range(0, len(at), 1 << 16):
                s = slice(k, k + (1 << 16))
                yield _evidence(at[s], bad[s], good[s])

        for b in batches:
            for text, toxic in zip(b.column(0), b.column(1)):
                own = bytearray()
                low = text.as_py().lower()
                for w in set(_LETTERS.findall(low)):
                    if w not in known:
                        if len(known) > KNOWN_WORDS:
                            known.clear()
                        known[w] = np.array(slots(w), np.int32).tobytes()
                    own += known[w]
                share = weigh(low, toxic.as_py())
                at, times = np.unique(np.frombuffer(own, np.int32), return_counts=True)
                held.append(np.concatenate([at, *[at_level(at[times >= k], k) for k in LEVELS]]))
                shares.append(share)
                n[1] += share
                n[0] += 1 - share
                size += len(held[-1])
                if size > HELD_SLOTS:
                    yield from sums()
                    held, shares, size = [], [], 0
        if held:
            yield from sums()
        yield _evidence(np.array([-1]), np.array([n[1]]), np.array([n[0]]))

    # rounded before they are added: sums of any order agree
    exact = lambda c: F.sum(F.round(F.col(c) * 1024).cast("long")).cast("double") / 1024
    sums = sample.select("text", "toxic").mapInArrow(count, "slot long, bad double, good double").groupBy("slot").agg(exact("bad").alias("bad"), exact("good").alias("good"))
    sums = materialize(sums, "slots")
    whole = sums.where("slot = -1").first()
    bad, good = (float(whole["bad"]), float(whole["good"])) if whole else (0.0, 0.0)
    if bad < 1e-6 or good < 1e-6:
        return [], bad, good, frozenset()
    base = bad / (bad + good)
    n, share = F.col("bad") + F.col("good"), F.col("bad") / (F.col("bad") + F.col("good"))
    some = lambda x: F.when(x > 1e-9, x * F.log(F.greatest(x, F.lit(1e-9)))).otherwise(0.0)
    gain = n * (some(share) + some(1 - share) - share * float(np.log(base)) - (1 - share) * float(np.log(1 - base)))
    rows = sums.where((F.col("slot") >= 0) & (F.col("bad") >= 2.5)).withColumn("gain", gain).where((share > min(0.5, 3 * base)) & (F.col("gain") > EVIDENCE))
    rows = rows.orderBy(F.desc("gain"), "slot").limit(MOST_FEATURES).collect()  # bounded
    words = {slots(w)[0]: w for w in _OF_WORD}
    seen = sums.where(F.col("slot").isin(list(words))).collect()  # a row a word of the lexicons at most
    discard(sums)
    return [(r["slot"], r["bad"], r["good"]) for r in rows], bad, good, frozenset(words[r["slot"]] for r in seen if r["good"] > r["bad"])


class LabelModel:
    """Class-conditional rates of voters from their first and second moments over all documents."""

    def __init__(self, joint: np.ndarray, n: int, prior: float) -> None:
        self.prior = prior
        size = len(joint)
        mean = np.diag(joint) / max(n, 1)
        cov = joint / max(n, 1) - np.outer(mean, mean)
        scale = np.sqrt(np.maximum(mean * (1 - mean), 1e-12))
        rho = cov / np.outer(scale, scale)
        apart = ~np.eye(size, dtype=bool)
        fired = mean > 0
        limit = max(0.15, 4 / np.sqrt(max(n, 1)))
        # a_i^2 = rho_ij rho_ik / rho_jk: the median over all (j, k) withstands some correlated pairs
        a = np.zeros(size)
        for i in np.nonzero(fired)[0]:
            others = np.nonzero(fired & (np.arange(size) != i))[0]
            with np.errstate(divide="ignore", invalid="ignore"):
                square = np.outer(rho[i, others], rho[i, others]) / rho[np.ix_(others, others)]
            square = square[(np.abs(rho[np.ix_(others, others)]) > 0.02) & apart[np.ix_(others, others)]]
            a[i] = np.sqrt(np.clip(np.median(square), 0, 1)) if len(square) else 0.5
        for _ in range(3):  # set pairs aside that are correlated beyond the class, fit the others
            apart = ~np.eye(size, dtype=bool) & (np.abs(rho - np.outer(a, a)) < limit)
            use = apart & np.outer(fired, fired)
            for _ in range(200):
                top, low = (use * rho * a[None, :]).sum(1), (use * a[None, :] ** 2).sum(1)
                a = np.clip(0.5 * a + 0.5 * np.where(low > 0, top / np.maximum(low, 1e-9), 0), 0, 1)
            rest = rho - np.outer(a, a)
        apart = ~np.eye(size, dtype=bool) & (np.abs(rest) < limit)
        self.correlation = np.where(~apart & ~np.eye(size, dtype=bool) & np.outer(fired, fired), np.clip(rest, 0, 1), 0)
        spread = a * scale
        self.fires_bad = np.clip(mean + np.sqrt((1 - prior) / prior) * spread, 1e-6, 1 - 1e-6)
        self.fires_good = np.clip(mean - np.sqrt(prior / (1 - prior)) * spread, 1e-6, 1 - 1e-6)
        self.mean, self.scale = mean, scale
        # a voter's say is shared with those that merely repeat it
        self.say = np.where(fired, 1 / (1 + self.correlation.sum(1)), 0)
        self.accuracy = a
        self.gold = (0.0, 0.0)

    def bits(self, masks: np.ndarray) -> np.ndarray:
        return np.stack([(masks >> np.uint64(k) & np.uint64(1)).astype(float) for k in range(len(self.say))], 1)

    def add_labels(self, masks: np.ndarray, toxic: np.ndarray) -> None:
        """The given labels of some rows as a voter: its accuracy is what makes its correlations products a * a_j.

        Voters that hardly fire beside others (those of another language, say) have no pairs that tell their accuracy;
        theirs follows from the pair with this voter. How often any voter fires outside the class is not put below what the
        rows labelled so show."""
        bits, mean = self.bits(masks), float(toxic.mean())
        scale = np.sqrt(max(mean * (1 - mean), 1e-12))
        spread = bits.std(0)
        rho = np.where(spread > 0, ((bits - bits.mean(0)) * (toxic - mean)[:, None]).mean(0) / np.maximum(spread * scale, 1e-9), 0)
        weight = self.say * self.accuracy
        self.gold_accuracy = float(np.clip((weight * rho).sum() / max((weight * self.accuracy).sum(), 1e-9), 0.0, 0.98))
        weak = (self.accuracy < LEAST_ACCURACY) & (spread > 0)
        own = np.where(weak, np.clip(rho / max(self.gold_accuracy, 1e-3), 0, 1), self.accuracy)
        least = (bits[toxic < 0.5].sum(0) + 0.5) / ((toxic < 0.5).sum() + 1)
        inside = np.clip(self.mean + np.sqrt((1 - self.prior) / self.prior) * own * self.scale, 1e-6, 1 - 1e-6)
        outside = np.clip(self.mean - np.sqrt(self.prior / (1 - self.prior)) * own * self.scale, least, 1 - 1e-6)
        self.accuracy, self.fires_bad, self.fires_good = own, np.maximum(inside, outside), outside
        bad = np.clip(mean + np.sqrt((1 - self.prior) / self.prior) * self.gold_accuracy * scale, 1e-3, 1 - 1e-3)
        good = np.clip(mean - np.sqrt(self.prior / (1 - self.prior)) * self.gold_accuracy * scale, 1e-3, 1 - 1e-3)
        self.gold = (float(np.log((1 - bad) / (1 - good))), float(np.log(bad / good)))

    def posterior(self, masks: np.ndarray, toxic: np.ndarray) -> np.ndarray:
        """toxic: 1, 0, or -1 where no label is given."""
        return _sigmoid(self.logit(masks) + np.where(toxic < 0, 0.0, np.where(toxic > 0, self.gold[1], self.gold[0])))

    def logit(self, masks: np.ndarray) -> np.ndarray:
        """Log odds of the class; a voter that doesn't fire abstains."""
        return np.log(self.prior / (1 - self.prior)) + self.bits(masks) @ (self.say * np.log(self.fires_bad / self.fires_good))


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def train_linear(rows: np.ndarray, columns: np.ndarray, soft: np.ndarray, width: int, steps: int = 400, ridge: float = 3e-5) -> tuple[float, np.ndarray]:
    """Logistic regression on soft labels: bias and weights (full-batch Adam)."""
    w, bias = np.zeros(width), float(np.log((soft.mean() + 1e-3) / (1.001 - soft.mean())))
    m, v = np.zeros(width + 1), np.zeros(width + 1)
    for t in range(1, steps + 1):
        error = _sigmoid(bias + np.bincount(rows, w[columns], len(soft))) - soft
        g = np.append(np.bincount(columns, error[rows], width) / len(soft) + ridge * w, error.mean())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
        w, bias = w - step[:-1], bias - step[-1]
    return bias, w


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> tuple[float, dict[int, float]]:
    """Bias and slot weights of the classifier. labels: (doc_id, toxic); only rows outside the held-out fold count."""
    texts = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    known = labels.select(F.col("doc_id").cast("long"), (F.col("toxic") > 0).alias("toxic")).where(F.col("toxic").isNotNull() & (remainder() != HELD_OUT))
    known = materialize(known.orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(sample_rows), "known")  # bounded by sample_rows
    if few(known, 0):
        rows = texts.where(remainder() != HELD_OUT).withColumn("toxic", F.lit(None).cast("boolean"))
    else:
        rows = texts.join(F.broadcast(known), "doc_id")
    # one row of a doc_id, text and label, sample_rows of them, whatever is repeated how often
    keyed = rows.withColumns({"_text": F.xxhash64("text"), "_toxic": F.coalesce(F.col("toxic").cast("int"), F.lit(-1)), "_id": F.coalesce("doc_id", F.lit(0))})
    names = ["_id", "_text", "_toxic"]
    drawn = materialize(keyed.select(*names).distinct().orderBy(F.xxhash64("_id", "_text"), *names).limit(sample_rows), "drawn")
    sample = keyed.join(F.broadcast(drawn), names, "left_semi").dropDuplicates(names).select("doc_id", "text", "toxic")
    sample = materialize(sample.repartition(24), "sample")
    stems, bad, good, quiet = _mine(sample.where("toxic is not null"), lambda _, toxic: float(toxic))
    # of stems that fire on equally many rows of both sides (prefixes of one word) one is a voter
    alone = list({(b, g): s for s, b, g in reversed(stems) if b >= PURE * (b + g)}.values())[::-1]
    mined = {s: len(LEXICONS) + len(_PATTERNS) + i for i, s in enumerate(alone[:MINED_VOTERS])}
    count = len(LEXICONS) + len(_PATTERNS) + len(mined)

    def moments(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, sums, n = _Votes(mined, quiet), np.zeros((count, count), np.int64), 0
        for b in batches:
            masks = np.array([words.mask(t.as_py().lower()) for t in b.column(0)], np.uint64)
            n += len(masks)
            masks = masks[masks > 0]
            bits = np.stack([(masks >> np.uint64(k) & np.uint64(1)).astype(np.int64) for k in range(count)], 1)
            sums += bits.T @ bits
        i, j = np.nonzero(sums)
        at = np.append(i * count + j, -1)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(np.append(sums[i, j], n), pa.int64())], ["at", "n"])

    joint, n = np.zeros((count, count)), 0
    sums = materialize(texts.select("text").mapInArrow(moments, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")), "moments")
    for r in sums.collect():  # count^2 rows at most
        if r["at"] < 0:
            n = r["n"]
        else:
            joint[divmod(r["at"], count)] = r["n"]
    model = LabelModel(joint, n, float(np.clip(bad / (bad + good) if bad and good else PRIOR, 0.01, 0.5)))

    def told(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Votes(mined, quiet)
        for b in batches:
            masks = np.array([words.mask(t.as_py().lower()) for t in b.column(0)], np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(masks.view(np.int64)), b.column(1)], ["mask", "toxic"])

    if bad and good:  # sample_rows numbers at most
        got = sample.where("toxic is not null").select("text", "toxic").mapInArrow(told, "mask long, toxic boolean").toArrow()
        model.add_labels(got.column("mask").to_numpy().view(np.uint64), got.column("toxic").to_numpy(zero_copy_only=False).astype(float))

    def weigh() -> Callable[[str, bool | None], float]:
        words = _Votes(mined, quiet)
        known: dict[tuple, float] = {}  # as many as there are different sets of votes

        def of(low: str, toxic: bool | None) -> float:
            key = (words.mask(low), toxic)
            if key not in known:
                known[key] = float(model.posterior(np.array([key[0]], np.uint64), np.array([-1 if toxic is None else int(toxic)]))[0])
            return known[key]

        return of

    found = _mine(sample, weigh())[0]
    lexicon_slots = {slots(w)[0] for w in _OF_WORD}
    features = {s: i for i, s in enumerate(dict.fromkeys([*(f[0] for f in found), *sorted(lexicon_slots)]))}

    def vectors(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, share = _Words(features), weigh()
        for b in batches:
            hits, soft = [], []
            for text, toxic in zip(b.column(0), b.column(1)):
                low = text.as_py().lower()
                hits.append(sorted(features[s] for s in words.of(low)))
                soft.append(share(low, toxic.as_py()))
            yield pa.RecordBatch.from_arrays([pa.array(hits, pa.list_(pa.int32())), pa.array(soft, pa.float64())], ["hits", "soft"])

    # at most sample_rows short lists
    rows, columns, soft = _design(sample.select("text", "toxic").mapInArrow(vectors, "hits array<int>, soft double").toArrow())
    weights = np.zeros(len(features))
    bias = float(np.log(model.prior / (1 - model.prior)))
    if len(soft):
        bias, weights = train_linear(rows, columns, soft, len(features))
    # lexicon words that the sample does not show keep a prior weight of their own
    unseen = np.bincount(columns, minlength=len(features)) == 0
    for s in lexicon_slots:
        if unseen[features[s]]:
            weights[features[s]] = 1.5
    discard(known, drawn, sample, sums)
    return bias, dict(zip(features, weights.tolist()))


def _design(got: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row and column numbers of the hits, and soft labels; rows in an order of their own (by hits, then label), so that reruns agree."""
    hits, soft = got.column("hits").combine_chunks(), got.column("soft").to_numpy()
    sizes, flat = hits.value_lengths().to_numpy(zero_copy_only=False), hits.flatten().to_numpy()
    ends = np.cumsum(sizes, dtype=np.int64)
    raw = flat.astype(">i4").tobytes()  # big-endian: bytes are in the order of the lists
    order = sorted(range(len(soft)), key=lambda i: (raw[4 * (ends[i] - sizes[i]) : 4 * ends[i]], soft[i]))
    columns = [flat[ends[i] - sizes[i] : ends[i]] for i in order]
    rows = np.repeat(np.arange(len(soft)), sizes[order])
    return rows, np.concatenate(columns).astype(np.int64) if columns else np.zeros(0, np.int64), soft[order]


def score(docs: DataFrame, bias: float, weights: dict[int, float], *keep: str) -> DataFrame:
    """The columns named in keep and score, the classifier's probability for the whole text."""
    kept = docs.select(*keep, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_text"))
    schema = docs.select(*keep).withColumn("score", F.lit(0.0)).schema

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words(weights)
        for b in (whole.slice(at, 256) for whole in batches for at in range(0, whole.num_rows, 256)):
            sums = np.array([bias + sum(map(weights.__getitem__, words.of(t.as_py().lower()))) for t in b.column(len(keep))])
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(_sigmoid(sums), pa.float64())], [*keep, "score"])

    return kept.mapInArrow(run, schema)


def op1_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    bias, weights = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = score(docs, bias, weights, "doc_id")
    return out.select("doc_id", (remainder() == HELD_OUT).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
