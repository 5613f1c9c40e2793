"""Toxicity by a weighted finite-state pattern grammar over clauses.

A lexicon maps words to symbols: insult or threat (with a weight), target, first person, modal verb, negation, reporting verb,
each with the quotes around it, and the end of a clause. Small weighted transducers (``Machine``: tables of next states
and of weights, by state and symbol) read the symbols and are composed to one by the product of their states:

* threat: a verb of harm counts whole after a first person and a modal verb (or such a contraction) within ``NEAR`` words, or at the start of a clause;
* insult: after a person and a form of "to be" within ``NEAR`` words an insult counts more;
* negation lowers a match within the ``NEAR`` words after it;
* reported speech (a reporting verb earlier in the clause) and open quotes lower it;
* target raises a match with a person word within ``NEAR`` words. It needs words on
  either side, so it is a pair of machines, one read from the left, composed with the others, and one from the right; a threat needs its target after it.

A match weighs its lexicon weight times the composed machine's weight. A clause's score is the sum of its matches' weights;
a document's evidence is a saturating sum over matched clauses, made a probability by a logistic curve.
Insults and their weights (log odds) are learned from labelled documents: whole words, and families of ``WORDS`` or more different words that
begin with the same ``FAMILY`` letters or more. Published English words in their inflections are seeds; threats weigh as much as the seeds do on average. The curve is fitted on the same rows. Training
reads at most ``MAX_ROWS`` labelled rows, chosen by hash; all documents are scored whole.
Only the text enters a score.
"""

from __future__ import annotations

import math
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernel import Words, chunks, slices
from .tables import discard, stored

MAX_ROWS = 20_000
PRIOR = 8
SHORTEST, FAMILY, LONGEST, WORDS = 3, 5, 12, 3
NEAR = 4
#: Word lists (fixed values).
INSULTS = "idiot moron stupid loser scum trash worthless pathetic disgusting clown imbecile dumb filthy vermin".split()
THREATS = "kill murder destroy hurt stab shoot strangle burn beat crush".split()
ENDINGS = ["", "s", "es", "'s", "d", "ed", "r", "er", "ers", "ing", "ly"]
FIRST = set("i we someone somebody ich wir je nous yo".split())
MODAL = set("will shall would could should must might going gonna want wanna need hope swear let promise werde werden vais allons voy vamos".split())
FIRST_MODAL = set("i'll we'll i'm we're i'd we'd let's".split())
COPULA = set("is are was were be am r you're he's she's they're bist ist seid sind est es sont eres sois son".split())
TARGETS = set("you your yours yourself u ya he she they them him her his their these those people du dich dir ihr euch tu te toi vous votre ton usted ustedes tus".split())
NEGATIONS = set("not no never isn't aren't don't doesn't wasn't without hardly nicht kein keine nie pas jamais nunca tampoco".split())
REPORTING = set("said says say told called calls wrote quoted reported claims claimed according sagte dit dijo".split())
#: Bytes that are not part of words become spaces; clause ends become line feeds; quotes stay.
SIGNS = bytes(b if b >= 128 or chr(b).isalpha() or b == 39 else 34 if b == 34 else 10 if chr(b) in ".!?;:\n\r" else 32 for b in range(256))


def plain(text: str | None) -> bytes:
    return b"" if text is None else text.lower().encode("utf-8", "replace").translate(SIGNS)


def training_rows(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """(text, toxic) of at most ``max_rows`` labelled documents that are not held out."""
    some = labels.where("doc_id is not null and toxic is not null and crc32(cast(doc_id as string)) % 4 != 2")
    some = some.select("doc_id", "toxic").orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(max_rows)
    return docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").select("text", "toxic")


def learn_stems(rows: DataFrame) -> dict[bytes, float]:
    """Weights (log odds) of the words (with a final ``$``) and families of words (their common beginning) that mark toxic documents.

    A word or family must be far likelier in toxic documents than chance allows, given how many were tried. A beginning is a family if ``WORDS`` different words of
    toxic documents share it, so that one word's beginning never stands for others; of beginnings of each other, and of words they hold, the shortest stands for all.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, Counter] = {0: Counter(), 1: Counter()}
        for batch in slices(batches):
            for raw, toxic in zip(map(plain, batch.column(0).to_pylist()), batch.column(1).to_pylist()):
                words = {w for x in raw.split() if len(w := x.strip(b"\x22'").decode("utf-8", "replace")) >= SHORTEST}
                stems = {w[:n] for w in words for n in range(FAMILY, min(len(w), LONGEST) + 1)} | {w + "$" for w in words}
                counts[int(toxic == 1)].update(stems)
                counts[int(toxic == 1)][""] += 1
        stems = list(counts[1].keys() | counts[0].keys())
        if stems:
            yield pa.RecordBatch.from_arrays([pa.array(stems, pa.string()), *(pa.array([counts[k][s] for s in stems], pa.int64()) for k in (1, 0))], ["stem", "bad", "good"])

    counts = rows.select("text", F.col("toxic").cast("long")).mapInArrow(run, "stem string, bad long, good long")
    total = stored(counts.groupBy("stem").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")), "stems")
    n = total.where("stem = ''").first()
    if n is None or not n["bad"] or not n["good"]:
        discard(total)
        return {}
    rate = n["bad"] / (n["bad"] + n["good"])
    purity = F.col("bad") / (F.col("bad") + F.col("good") + F.lit(0.5))
    llr = F.col("bad") * F.log(purity / F.lit(rate)) + (F.col("good") + 0.5) * F.log((1 - purity) / F.lit(1 - rate))
    found = total.where("stem <> '' and bad >= 4").where(purity >= max(0.7, min(0.95, 2 * rate))).where(llr >= 10).select("stem", "bad", "good")
    word = F.endswith("stem", F.lit("$"))
    beginnings = lambda df: df.select("stem", F.explode(F.expr(f"sequence({FAMILY}, greatest({FAMILY}, least({LONGEST}, length(stem) - 1)))")).alias("n")).where("n < length(stem)").select("stem", F.expr("substring(stem, 1, n)").alias("prefix"))
    shared = beginnings(total.where(word & (F.col("bad") > 0)).select("stem")).groupBy("prefix").agg(F.count(F.lit(1)).alias("words"))
    families = found.where(~word).join(shared.where(F.col("words") >= WORDS).select(F.col("prefix").alias("stem")), "stem", "left_semi")
    found = stored(families.unionByName(found.where(word)), "found")
    longer = beginnings(found.select("stem")).join(found.where(~word).select(F.col("stem").alias("prefix")), "prefix").select("stem").distinct()
    weights: dict[bytes, float] = {}
    for r in found.join(longer, "stem", "left_anti").orderBy(F.length("stem"), "stem").collect():
        weights[r["stem"].encode()] = math.log((r["bad"] + 0.5) / (n["bad"] + 1)) - math.log((r["good"] + 0.5) / (n["good"] + 1))
    discard(total, found)
    return weights


#: Symbols: kind of word, whether it names a person, quotes that open or close before (1) or after (2) it; the last ends a clause.
OTHER, NEGATION, REPORT, INSULT, THREAT, SUBJECT, AUXILIARY, INTENT, COPULAR = range(9)
END = 54
KIND, PERSON, QUOTE = (np.array([*(f(x) for x in range(END)), -1]) for f in (lambda x: x // 6, lambda x: x // 3 % 2, lambda x: x % 3))
CACHED = 50_000
#: The kind of a word by its list, the first that has it.
ROLES = [(NEGATION, NEGATIONS), (REPORT, REPORTING), (INTENT, FIRST_MODAL), (SUBJECT, FIRST), (AUXILIARY, MODAL), (COPULAR, COPULA)]


class Machine:
    """A weighted transducer: next state and weight by (state, symbol). It starts in state 0."""

    def __init__(self, step: np.ndarray, weight: np.ndarray):
        self.step, self.weight = step, weight
        self.flat = array("H", step.ravel().tolist())

    def compose(self, other: Machine) -> Machine:
        """Both machines reading the same symbols: states are pairs, weights multiply."""
        n, m = len(self.step), len(other.step)
        step = self.step[:, None, :] * m + other.step[None, :, :]
        weight = self.weight[:, None, :] * other.weight[None, :, :]
        return Machine(step.reshape(n * m, -1), weight.reshape(n * m, -1))

    def read(self, symbols: list[int], state: int = 0) -> tuple[np.ndarray, int]:
        """The state before each symbol, and the one after the last."""
        flat, width, states = self.flat, self.step.shape[1], []
        for x in symbols:
            states.append(state)
            state = flat[state * width + x]
        return np.array(states, np.int64), state


def _since(hits: np.ndarray, factor: float) -> Machine:
    """State k > 0: a hit lies at most ``NEAR`` words back. Weighs what is read there with ``factor``."""
    step = np.tile(np.maximum(np.arange(NEAR + 1) - 1, 0)[:, None], (1, END + 1))
    step[:, :END][:, hits[:END]] = NEAR
    step[:, END] = 0
    weight = np.ones(step.shape)
    weight[1:] = factor
    return Machine(step, weight)


def _reported() -> Machine:
    """State 2 r + q: a reporting verb earlier in the clause, open quotes (which clauses do not close)."""
    step, weight = np.zeros((4, END + 1), np.int64), np.ones((4, END + 1))
    for state in range(4):
        r, q = divmod(state, 2)
        step[state, END] = q
        for x in range(END):
            inside = q ^ (QUOTE[x] == 1)
            step[state, x] = 2 * (r or KIND[x] == REPORT) + (inside ^ (QUOTE[x] == 2))
            weight[state, x] = 0.6 if r or inside else 1.0
    return Machine(step, weight)


def _threat(idle: float) -> Machine:
    """Weighs verbs of harm: 1 at the start of a clause or with intent at most ``NEAR`` words back (a first person and a modal verb after it), else ``idle``.

    State 0: start of a clause; 1: nothing; 1 + k: a first person at most NEAR - k words back; 1 + NEAR + k: intent.
    """
    many = 2 + 2 * NEAR
    step, weight = np.zeros((many, END + 1), np.int64), np.ones((many, END + 1))
    for state in range(1, many):
        later = max(1, state - 1) if state <= 1 + NEAR else (state - 1 if state > 2 + NEAR else 1)
        for x in range(END):
            first, intent = 1 + NEAR, 1 + 2 * NEAR
            step[state, x] = intent if KIND[x] == INTENT or KIND[x] == AUXILIARY and state > 1 else max(later, first) if KIND[x] == SUBJECT and later <= first else later
            if KIND[x] == THREAT and state <= 1 + NEAR:
                weight[state, x] = idle
    step[0] = step[1]
    step[:, END] = 0
    return Machine(step, weight)


def _called(factor: float) -> Machine:
    """Weighs insults by ``factor`` at most ``NEAR`` words after a form of "to be" that follows a person within as many: "you are such a ..."."""
    many = 1 + 2 * NEAR
    step, weight = np.zeros((many, END + 1), np.int64), np.ones((many, END + 1))
    for state in range(many):
        later = 0 if state in (0, 1, 1 + NEAR) else state - 1
        for x in range(END):
            step[state, x] = 2 * NEAR if KIND[x] == COPULAR and (state or PERSON[x]) else later if later > NEAR else NEAR if PERSON[x] or KIND[x] == SUBJECT else later
            if KIND[x] == INSULT and state > NEAR:
                weight[state, x] = factor
    return Machine(step, weight)


class Grammar:
    """The lexicon and the composed transducers. ``stems``: learned insult stems; a final ``$`` marks a whole word."""

    def __init__(self, stems: dict[bytes, float]):
        self.stems = stems
        learned = {k: max(0.5, v) for k, v in stems.items()}
        # learned weights of a seed count for all its inflections
        own = {s: max([3.0, *(v for k, v in learned.items() if (k[:-1] == s.encode() if k.endswith(b"$") else s.encode().startswith(k)))]) for s in INSULTS}
        seeds = {f"{s}{e}$".encode(): w for s, w in own.items() for e in ENDINGS}
        self.insults = seeds | {k: max(v, seeds.get(k, 0.0)) for k, v in learned.items()}
        harm = sum(own.values()) / len(own)
        verbs = {s for v in THREATS for s in (v, v.removesuffix("e") if v.endswith("e") else v, v + v[-1])}
        self.threats = {f"{s}{e}$".encode() for s in verbs for e in ENDINGS if s in THREATS or e in ("ed", "ing", "er", "ers")} - set(self.insults)
        self.weight = self.insults | {s: harm for s in self.threats}
        tables: dict[int, list[bytes]] = {}
        for s in self.weight:
            tables.setdefault(0 if s.endswith(b"$") else len(s), []).append(s)
        self.tables = {n: np.unique(Words([x.rstrip(b"$") for x in xs]).hashes()) for n, xs in tables.items()}
        self.longest = max(map(len, self.weight))
        person = _since(PERSON == 1, 1.0)
        self.left = _since(KIND == NEGATION, 0.25).compose(_threat(0.05)).compose(_called(1.25)).compose(_reported()).compose(person)
        self.right, self.persons = person, len(person.step)
        self.symbols: dict[bytes, tuple[int, float]] = {}

    def __reduce__(self):
        return Grammar, (self.stems,)  # tasks make the tables anew

    def _match(self, word: bytes) -> tuple[float, bool]:
        """(weight, is a threat) of a word; 0 if it matches nothing."""
        if word + b"$" in self.threats:
            return self.weight[word + b"$"], True
        return max((self.insults.get(key, 0.0) for key in (word + b"$", *(word[:n] for n in range(SHORTEST, min(len(word), self.longest) + 1)))), default=0.0), False

    def _symbol(self, raw: bytes) -> tuple[int, float]:
        """The symbol of a word with the quotes around it, and its lexicon weight."""
        if (found := self.symbols.get(raw)) is None:
            word, marks = raw.strip(b"\x22'"), raw.count(b"\x22")
            text = word.decode("utf-8", "replace")
            kind = next((k for k, names in ROLES if text in names), OTHER)
            weight, threat = self._match(word) if kind == OTHER else (0.0, False)
            kind = kind if not weight else THREAT if threat else INSULT
            spoken = raw.strip(b"\x22").decode("utf-8", "replace")
            person = spoken in TARGETS or spoken.rpartition("'")[0] in TARGETS
            quote = 1 if marks and not raw.endswith(b"\x22") else 2 if marks % 2 else 0
            if len(self.symbols) >= CACHED:
                self.symbols.clear()
            found = self.symbols[raw] = kind * 6 + person * 3 + quote, weight
        return found

    def read(self, symbols: list[int], weights: list[float], state: int = 0) -> tuple[float, int]:
        """The matches' summed weight, and the left machine's state after the last symbol."""
        x = np.array(symbols, np.int64)
        before, state = self.left.read(symbols, state)
        after = self.right.read(symbols[::-1])[0][::-1]
        aimed = (before % self.persons > 0) | (after > 0) | (PERSON[x] == 1)
        aim = np.where(KIND[x] == THREAT, np.where(after > 0, 1.5, 0.05), np.where(aimed, 1.5, 1.0))
        return float((np.array(weights) * self.left.weight[before, x] * aim).sum()), state

    def clause(self, words: list[bytes], quoted: bool) -> tuple[float, bool]:
        """The clause's score, and whether quotes stay open after it."""
        found = [self._symbol(w) for w in words] + [(END, 0.0)]
        score, state = self.read(*map(list, zip(*found)), state=int(quoted) * self.persons)
        return score, bool(state // self.persons % 2)

    def evidence(self, texts: list[bytes]) -> np.ndarray:
        """The evidence of plain texts: 0 where no word matches."""
        out = np.zeros(len(texts))
        for a, b in chunks(texts):
            w = Words(texts[a:b])
            if not len(w):
                continue
            mark = (w.buf == 34) | (w.buf == 39)  # quotes and apostrophes around it are not part of the word
            w.start, w.end = w.start.copy(), w.end.copy()
            at = np.flatnonzero(mark[w.start])
            while len(at):
                w.start[at] += 1
                at = at[w.start[at] < w.end[at]]
                at = at[mark[w.start[at]]]
            at = np.flatnonzero((w.end > w.start) & mark[w.end - 1])
            while len(at):
                w.end[at] -= 1
                at = at[mark[w.end[at] - 1]]  # a word that is all marks is empty by now
            doc, hit = w.doc_of(), np.zeros(b - a, bool)
            long = w.end - w.start
            for n, keys in self.tables.items():
                at = np.flatnonzero(long >= n) if n else np.arange(len(w))
                end = w.start[at] + n if n else w.end[at]
                h = w.spans(w.start[at], end)
                place = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
                hit[doc[at[keys[place] == h]]] = True
            for i in np.flatnonzero(hit).tolist():
                found: list[tuple[int, float]] = []
                for line in texts[a + i].split(b"\n"):
                    if line:
                        found += map(self._symbol, line.split())
                        found.append((END, 0.0))
                out[a + i] = self.read(*map(list, zip(*found)))[0]
        return 4.0 * np.tanh(out / 16.0) + 0.5 * np.log1p(out)


def fit_curve(x: np.ndarray, y: np.ndarray, times: np.ndarray | None = None, steps: int = 50) -> tuple[float, float]:
    """(intercept, slope >= 0) of a ridge logistic regression, by Newton's method; a row counts ``times`` as often.

    ``PRIOR`` invented documents of either kind (two insults, none) keep it sensible where labels are few.
    """
    two = float(4.0 * np.tanh(6.0 / 16.0) + 0.5 * np.log1p(6.0))
    x = np.concatenate([x, np.full(PRIOR, two), np.zeros(PRIOR)])
    y = np.concatenate([y, np.ones(PRIOR), np.zeros(PRIOR)])
    t = np.concatenate([np.ones(len(y) - 2 * PRIOR) if times is None else times, np.ones(2 * PRIOR)])
    a, b = math.log((t * y).sum() / (t * (1 - y)).sum()), 0.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-(a + b * x)))
        s = t * (p * (1 - p) + 1e-9)
        g = np.array([(t * (y - p)).sum(), (t * (y - p) * x).sum() - 0.05 * b])
        h = np.array([[s.sum(), (s * x).sum()], [(s * x).sum(), (s * x * x).sum() + 0.05]])
        step = np.linalg.solve(h, g)
        a, b = a + float(np.clip(step[0], -2, 2)), b + float(np.clip(step[1], -2, 2))
    return a, max(b, 0.1)


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS):
    """A function from plain texts to scores, fitted on the labelled rows that are not held out."""
    rows = stored(training_rows(docs, labels, max_rows), "training")  # read by two steps; rows that repeat an id are all in it
    grammar = Grammar(learn_stems(rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            x = grammar.evidence([plain(t) for t in batch.column(0).to_pylist()])
            yield pa.RecordBatch.from_arrays([pa.array(x), batch.column(1)], ["x", "toxic"])

    # evidence in steps of a thousandth, so that the table has a bounded size however often ids repeat
    sample = rows.select("text", (F.col("toxic") == 1).cast("long").alias("toxic")).mapInArrow(run, "x double, toxic long")
    sample = sample.groupBy(F.round("x", 3).alias("x"), "toxic").agg(F.count(F.lit(1)).alias("times")).orderBy("x", "toxic").collect()
    discard(rows)
    a, b = fit_curve(*(np.array([r[c] for r in sample], float) for c in ("x", "toxic", "times")))

    def score(texts: list[bytes]) -> np.ndarray:
        return 1 / (1 + np.exp(-(a + b * grammar.evidence(texts))))

    return score


def score_documents(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted of every row. Null and empty texts have the score of a text without matches.

    A null doc_id is not held out. Repeated rows are scored one by one. Without labels the seeds alone score.
    """
    score = train(docs, labels, max_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            p = score([plain(t) for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p), pa.array((p >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double, predicted int")
    return scored.select("doc_id", F.coalesce(F.expr("crc32(cast(doc_id as string)) % 4 = 2"), F.lit(False)).alias("held_out"), "score", "predicted")


def drop_toxic(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` that score below the threshold, all columns kept. No shuffle."""
    score = train(docs, labels, max_rows)
    names, place = docs.columns, docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            keep = pa.array(score([plain(t) for t in batch.column(place).to_pylist()]) < threshold)
            yield pa.RecordBatch.from_arrays([c.filter(keep) for c in batch.columns], names)

    return docs.mapInArrow(run, docs.schema)
