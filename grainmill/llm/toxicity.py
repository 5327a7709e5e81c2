"""Operator 7: toxicity by a fuzzy lexicon in context.

The lexicon is learned from labelled documents: words, and stems (beginnings of words), whose document counts
differ between the labels far beyond chance. Levenshtein automata of all terms, with swaps of neighbours as one edit, are
intersected with the lexicon's trie into one deterministic automaton, whose states are made when a word first reaches
them; whole batches of words step through it at once, so misspelled terms are found at the price of exact ones. Edits
are allowed by length (EDITS); digits stand for the letters they look like. A misspelled form has less weight than its
term; one that stands in clean labelled documents, such as a clean neighbour word, has the weight that they leave it, if
any, and a term with NEIGHBOURS such forms or more is not sought in other misspellings. Each hit also has a factor from its context window: quotation marks and verbs of saying lower it, address and
further hits raise it. A logistic curve, fitted on the labelled documents with hits, turns the sum into the score;
without hits it is their rate.

Fitting uses at most SAMPLE_POSITIVE + SAMPLE_NEGATIVE labelled rows (by hash of the id; whole texts) and weighs every
term of theirs that reaches MIN_SUPPORT, MIN_LIFT and MIN_RATIO; the lexicon has no other limit. Scoring is row by row:
no shuffle, memory of a batch and of the automaton, which starts anew beyond MAX_STATES states.

Null and empty text score as text without hits; without labelled rows every score is 0; rows with a null id are not
learned from; equal rows give equal results; an empty table gives no rows; documents with several labels count as toxic
if one label says so; input columns travel in a struct, so their names cannot clash.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grainmill.llm._common import WORKER_STATE, beside, drop_states, spread, table
from grainmill.llm._text import by_size, code_points

SAMPLE_POSITIVE, SAMPLE_NEGATIVE = 1500, 4500
MIN_SUPPORT = 3
SAMPLE_PART = 500  # documents of the sample in a task
MIN_RATIO, STRONG, MIN_LIFT = 13.0, 60.0, 30.0  # likelihood-ratio statistics of a term; rate among toxic over rate among others
EDITS = [(0, 0), (5, 1), (9, 2)]  # from this length on, so many edits; stems are held one step shorter
STEM = (3, 12)
MISSPELLED, NEIGHBOURS = 0.8, 3  # share of a term's weight
MAX_STATES = 50_000
WINDOW = 60  # code points on either side
MOST = 20.0  # evidence of one text
LOOKS_LIKE = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}
QUOTES = "\"“”„«»‘’"
SAYING = {"said", "says", "quote", "quoted", "quoting", "called", "wrote", "word", "term", "dit", "mot", "sagte", "wort", "dijo", "palabra"}
ADDRESS = {"you", "your", "youre", "u", "tu", "toi", "vous", "du", "dich", "ihr", "usted", "ustedes", "te"}


def _classes() -> np.ndarray:
    """Code point -> 0 for what ends a word, 1 for a letter or digit, 2 for a sign that stands for a letter."""
    if "word_chars" not in WORKER_STATE:
        kinds = np.fromiter((chr(c).isalnum() for c in range(0x110000)), np.uint8, 0x110000)
        kinds[[ord("@"), ord("$")]] = 2
        WORKER_STATE["word_chars"] = kinds
    return WORKER_STATE["word_chars"]


@dataclass
class Lexicon:
    """Terms (a trailing * marks a stem) and weights."""

    terms: list[str] = field(default_factory=list)
    weights: list[float] = field(default_factory=list)
    forms: dict[str, float] = field(default_factory=dict)  # weights of misspelled forms that stand in clean documents
    plain: set[int] = field(default_factory=set)  # terms with so many of these that other misspellings say nothing
    curve: tuple[float, float] = (0.0, -50.0)  # slope and offset where there is evidence
    base: float = 0.0  # score without any

    def weight(self, term: int, edits: int, form: str) -> float:
        own = self.weights[term]
        return own if edits == 0 else self.forms.get(form, 0.0 if term in self.plain else MISSPELLED * own)

    @property
    def automaton(self) -> "Automaton":
        made = self.__dict__.get("_automaton")
        if made is None or len(made.states) > MAX_STATES:
            made = self.__dict__["_automaton"] = Automaton(self.terms, self.weights)
        return made

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_automaton"}


def edits_for(term: str) -> int:
    n = len(term.rstrip("*")) - (2 if term.endswith("*") else 0)
    return max(e for size, e in EDITS if n >= size) if n > 0 else 0


class Automaton:
    """The deterministic automaton of all terms' Levenshtein automata over their trie. A state is a set of trie nodes
    with edits spent, of swaps under way, and of stems already met; state 0 is dead, 1 the start. table: states x letter
    classes, -1 where no word has been yet; accepts: term and edits at a word's end."""

    def __init__(self, terms: list[str], weights: list[float]) -> None:
        self.terms, self.weights = terms, weights
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[list[int]] = [[]]
        self.allowed = [0]  # most edits of a term below
        self.edits = [edits_for(t) for t in terms]
        for t, term in enumerate(terms):
            path = [0]
            for c in term.rstrip("*"):
                node = self.children[path[-1]].setdefault(c, len(self.children))
                if node == len(self.allowed):
                    self.children.append({})
                    self.ends.append([])
                    self.allowed.append(0)
                path.append(node)
            self.ends[path[-1]].append(t)
            for node in path:
                self.allowed[node] = max(self.allowed[node], self.edits[t])
        self.letters = [None, *sorted({c for x in self.children for c in x})]
        self.alphabet = {ord(c): k for k, c in enumerate(self.letters) if c}
        self.alphabet |= {ord(a): self.alphabet[ord(b)] for a, b in LOOKS_LIKE.items() if ord(b) in self.alphabet and ord(a) not in self.alphabet}
        self.stems = np.array([t.endswith("*") for t in terms], bool)
        self.depth = max((len(t) + 2 for t in terms), default=0)
        self.states: list[frozenset] = []
        self.index: dict[frozenset, int] = {}
        self.table, self.accepts = np.zeros((0, len(self.letters)), np.int32), np.zeros((0, 2), np.int32)
        self._state({})
        self.table[0] = 0
        self._state(self._closed({("node", 0, ""): 0}))

    def _closed(self, found: dict) -> dict:
        """Adds deletions of letters of a term, and stems that are complete; keeps the fewest edits of each."""
        todo = list(found)
        while todo:
            kind, node, _ = x = todo.pop()
            if kind != "node":
                continue
            e = found[x]
            for t in self.ends[node]:
                if self.stems[t] and e <= self.edits[t] and found.get(("stem", t, ""), 9) > e:
                    found["stem", t, ""] = e
            for child in self.children[node].values():
                if e + 1 <= self.allowed[child] and found.get(("node", child, ""), 9) > e + 1:
                    found["node", child, ""] = e + 1
                    todo.append(("node", child, ""))
        return found

    def _state(self, found: dict) -> int:
        state = frozenset(found.items())
        number = self.index.setdefault(state, len(self.states))
        if number == len(self.states):
            self.states.append(state)
            if number >= len(self.table):
                more = max(64, number)
                self.table = np.concatenate([self.table, np.full((more, len(self.letters)), -1, np.int32)])
                self.accepts = np.concatenate([self.accepts, np.full((more, 2), -1, np.int32)])
            met = [(e, -self.weights[n], n) for (kind, n, _), e in state if kind == "stem"]
            met += [(e, -self.weights[t], t) for (kind, n, _), e in state if kind == "node" for t in self.ends[n] if not self.stems[t] and e <= self.edits[t]]
            if met:
                e, _, t = min(met)
                self.accepts[number] = t, e
        return number

    def _next(self, state: int, letter: str | None) -> int:
        found: dict = {}

        def reach(key: tuple, cost: int) -> None:
            if cost < found.get(key, 9):
                found[key] = cost

        for (kind, node, wanted), e in self.states[state]:
            if kind == "stem":
                reach((kind, node, ""), e)
            elif kind == "swap":
                if letter == wanted:
                    reach(("node", node, ""), e)
            else:
                for c, child in self.children[node].items():
                    cost = e + (c != letter)
                    if cost <= self.allowed[child]:
                        reach(("node", child, ""), cost)
                    behind = self.children[child].get(letter) if c != letter else None
                    if behind is not None and e + 1 <= self.allowed[behind]:
                        reach(("swap", behind, c), e + 1)
                if e + 1 <= self.allowed[node]:
                    reach(("node", node, ""), e + 1)
        return self._state(self._closed(found))

    def step(self, states: np.ndarray, classes: np.ndarray) -> np.ndarray:
        new = self.table[states, classes]
        for key in np.unique(states[new < 0].astype(np.int64) * len(self.letters) + classes[new < 0]).tolist():
            state, k = divmod(key, len(self.letters))
            to = self._next(state, self.letters[k])
            self.table[state, k] = to  # after _next, which may move the table
        return self.table[states, classes]


def hits(texts: list[str], lex: Lexicon) -> list[list[tuple[int, int, int, int]]]:
    """(start, end, term, edits) of each text's words that the automaton accepts; texts are in lower case."""
    out: list[list] = [[] for _ in texts]
    if not lex.terms or not texts:
        return out
    cp, at = code_points(texts)
    kinds = _classes()[cp]
    word = kinds > 0
    sign = np.flatnonzero(kinds == 2)  # only between letters
    word[sign[(kinds[np.maximum(sign - 1, 0)] != 1) | (kinds[sign + 1] != 1)]] = False
    edge = np.diff(word.astype(np.int8), prepend=0)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    size = end - start
    auto = lex.automaton
    top = max(max(auto.alphabet) + 1, 256)
    to_class = np.zeros(top, np.int32)
    for c, k in auto.alphabet.items():
        to_class[c] = k
    cls = to_class[np.where(cp < top, cp, 0)]
    state, live = np.ones(len(start), np.int32), np.arange(len(start))
    for k in range(auto.depth):
        live = live[size[live] > k]
        new = auto.step(state[live], cls[start[live] + k])
        state[live] = new
        live = live[new > 0]
        if not len(live):
            break
    found = auto.accepts[state]
    over = size > auto.depth  # a longer word can only hold a stem, and stems are met by then
    term = found[:, 0]
    ok = np.flatnonzero((term >= 0) & (~over | auto.stems[np.maximum(term, 0)]))
    owner = np.searchsorted(at, start[ok], "right") - 1
    for k, j in zip(ok.tolist(), owner.tolist(), strict=True):
        out[j].append((int(start[k] - at[j]), int(end[k] - at[j]), int(found[k, 0]), int(found[k, 1])))
    return out


def context(text: str, own: tuple, all_hits: list[tuple]) -> float:
    """Factor of a hit: below 1 in quotation, above 1 in abuse."""
    a, b = own[:2]
    left, right = text[max(0, a - WINDOW) : a], text[b : b + WINDOW]
    around = set((left + " " + right).replace(",", " ").replace(".", " ").split())
    quoted = left[-1:] in QUOTES and left[-1:] != "" and right[:1] in QUOTES and right[:1] != ""
    factor = 0.35 if quoted else 1.0
    if around & SAYING:
        factor *= 0.7 if quoted or any(q in left for q in QUOTES) else 0.9
    if around & ADDRESS and not quoted:
        factor *= 1.15
    if any(0 < abs(h[0] - a) <= WINDOW for h in all_hits):
        factor *= 1.1
    return factor


def evidence(text: str, found: list[tuple], lex: Lexicon) -> float:
    weighed = [(h, w) for h in found if (w := lex.weight(h[2], h[3], text[h[0] : h[1]])) > 0]
    left = [h for h, _ in weighed]
    return min(sum(w * context(text, h, left) for h, w in weighed), MOST)


def _words(text: str | None) -> set[str]:
    return {w for w in "".join(c if c.isalpha() else " " for c in (text or "").lower()).split() if len(w) >= STEM[0]}


def _forms(word: str) -> list[str]:
    """The word and its stems."""
    return [word, *[word[:k] + "*" for k in range(STEM[0], min(len(word), STEM[1] + 1))]]


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """term, toxic documents, other documents: for words and their stems; columns text, toxic."""
    toxic, other = Counter(), Counter()
    for batch in batches:
        for text, label in zip(batch.column(0), batch.column(1), strict=True):
            (toxic if label.as_py() else other).update({t for w in _words(text.as_py()) for t in _forms(w)})
    names = list(toxic | other)
    for k in range(0, len(names), 100_000):
        part = names[k : k + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array([toxic[t] for t in part], pa.int64()), pa.array([other[t] for t in part], pa.int64())], ["term", "pos", "neg"])


def _ratio(p: np.ndarray, q: np.ndarray, n_pos: int, n_neg: int) -> np.ndarray:
    """Likelihood-ratio statistic of terms in p of n_pos toxic and q of n_neg other documents."""
    total = n_pos + n_neg
    out = np.zeros(len(p))
    for o, e in ((p, (p + q) * n_pos), (q, (p + q) * n_neg), (n_pos - p, (total - p - q) * n_pos), (n_neg - q, (total - p - q) * n_neg)):
        ok = (o > 0) & (e > 0)
        out[ok] += 2 * o[ok] * np.log(o[ok] * total / e[ok])
    return out


def shortlist(rows: list[tuple[str, int, int]], n_pos: int, n_neg: int) -> list[str]:
    """All strong precise terms of (term, toxic documents, other documents), strongest first; of equal ones whole words,
    then the longest stem. A stem with the counts of a longer term that begins with it holds the same documents, and
    only the first of such terms stays."""
    good = [(t, p, q) for t, p, q in rows if p >= MIN_SUPPORT and p * n_neg > MIN_LIFT * q * n_pos]
    ratio = _ratio(np.array([x[1] for x in good], float), np.array([x[2] for x in good], float), n_pos, n_neg) if good else []
    order = sorted((-round(float(r), 6), x[0].endswith("*"), -len(x[0]), x[0]) for r, x in zip(ratio, good, strict=True) if r >= MIN_RATIO)
    counts = {t: (p, q) for t, p, q in good}
    kept, begins = [], set()
    for *_, t in order:
        body, own = t.rstrip("*"), counts[t]
        if not t.endswith("*") or (body, own) not in begins:
            kept.append(t)
            begins.update((body[:k], own) for k in range(STEM[0], len(body) + 1))
    return kept


def choose(terms: list[str], toxic: np.ndarray, other: np.ndarray) -> list[tuple[str, float]]:
    """Terms and weights from documents x terms matrices. Each step takes the term that best explains the toxic
    documents that no chosen term explains yet, so chance terms find nothing left to explain; then terms that are
    strong by themselves (STRONG) join, unless a chosen stem holds them."""
    n_pos, n_neg = len(toxic), len(other)
    p, q = toxic.sum(0).astype(float), other.sum(0).astype(float)
    chosen: list[int] = []
    left = np.ones(n_pos, bool)
    while left.any() and len(terms):
        own = toxic[left].sum(0).astype(float)
        ratio = np.where(own >= MIN_SUPPORT, _ratio(own, q, int(left.sum()), n_neg), 0.0)
        best = int(ratio.argmax())
        if ratio[best] < MIN_RATIO:
            break
        chosen.append(best)
        left &= ~toxic[:, best]
    whole = _ratio(p, q, n_pos, n_neg)
    enough = max(MIN_RATIO, min(STRONG, 0.5 * whole.max(initial=0.0)))  # less where few documents are labelled
    for k in np.argsort(-whole, kind="stable"):
        body = terms[k].rstrip("*")
        held = any(terms[c].endswith("*") and body.startswith(terms[c][:-1]) or terms[k].endswith("*") and terms[c].startswith(body) for c in chosen)
        if k not in chosen and whole[k] >= enough and p[k] >= 0.02 * n_pos and not held:
            chosen.append(int(k))
    return [(terms[k], math.log((p[k] + 0.5) / (n_pos + 1)) - math.log((q[k] + 0.5) / (n_neg + 1))) for k in chosen]


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset, fitted by Newton steps with a weak prior."""
    a = np.array([1.0, -2.0])
    z = np.stack([x, np.ones_like(x)], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ a, -40, 40)))
        grad = z.T @ (y - p) - 0.02 * a
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + 0.02 * np.eye(2), grad)
        a = a + np.clip(step, -3, 3)
        if abs(step).max() < 1e-6:
            break
    return float(a[0]), float(a[1])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "toxic") -> Lexicon:
    """docs and labels: the rows that may be learned from. What reaches the driver is bounded by the sample's size."""
    spark = docs.sparkSession
    known = labels.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{label}`").alias("toxic")).where("toxic IS NOT NULL AND _id IS NOT NULL").groupBy("_id").agg(F.max("toxic").alias("toxic"))
    part = lambda y, n: known.where(F.col("toxic") == y).orderBy(F.xxhash64("_id"), "_id").limit(n)
    ids = part(1, SAMPLE_POSITIVE).unionAll(part(0, SAMPLE_NEGATIVE)).toPandas()
    if not len(ids):
        return Lexicon()
    chosen = F.broadcast(spark.createDataFrame(ids))  # bounded by the sample
    texts = docs.select(F.col(f"`{id_col}`").alias("own_id"), F.col(f"`{text}`").alias("text"))
    sample = texts.join(chosen, F.col("own_id") == F.col("_id")).select("text", F.col("toxic").cast("int").alias("toxic"))
    sample = sample.repartition(-(-len(ids) // SAMPLE_PART)).persist()
    try:
        n = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
        n_pos, n_neg = n.get(1, 0), n.get(0, 0)
        terms = sample.mapInArrow(_candidates, "term string, pos long, neg long").groupBy("term").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
        lift = (F.col("pos") / max(n_pos, 1)) / ((F.col("neg") + 0.5) / max(n_neg, 1))
        precise = F.col("pos") * n_neg > F.col("neg") * (MIN_LIFT * n_pos)
        best = terms.where((F.col("pos") >= MIN_SUPPORT) & (lift > 4) & precise)  # bounded by the sample's words
        rows = [tuple(r) for r in best.collect()]
        short = shortlist(rows, n_pos, n_neg)
        place = {t: k for k, t in enumerate(short)}

        def holds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Which shortlisted terms each document holds."""
            for batch in batches:
                found = []
                for text in batch.column(0):
                    terms_ = set()
                    for w in _words(text.as_py()):
                        terms_.update(place[t] for t in _forms(w) if t in place)
                    found.append(sorted(terms_))
                yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(found, pa.list_(pa.int32()))], ["toxic", "terms"])

        held = sample.mapInArrow(holds, "toxic int, terms array<int>").collect()  # the sample's rows, their shortlisted terms each
        sides = []
        for side in (1, 0):
            own = [r["terms"] for r in held if r["toxic"] == side]
            m = np.zeros((len(own), len(short)), bool)
            for i, places in enumerate(own):
                m[i, places] = True
            sides.append(m)
        chosen_terms = choose(short, *sides)
        lex = Lexicon([t for t, _ in chosen_terms], [w for _, w in chosen_terms])

        def forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Documents of either label in which a misspelled form stands."""
            got: Counter = Counter()
            for batch in batches:
                labels_ = batch.column(1).to_pylist()
                for at, texts in by_size(batch.column(0)):
                    low = [(t or "").lower() for t in texts]
                    for k, found in enumerate(hits(low, lex)):
                        got.update({(low[k][a:b], t, labels_[at + k]) for a, b, t, e in found if e})
            keys = list(got)
            kinds = [pa.string(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([*[pa.array([k[c] for k in keys], kinds[c]) for c in range(3)], pa.array([got[k] for k in keys], pa.int64())], ["form", "term", "toxic", "n"])

        spelled = sample.mapInArrow(forms, "form string, term int, toxic int, n long").groupBy("form", "term").agg(F.sum(F.expr("IF(toxic = 1, n, 0)")).alias("p"), F.sum(F.expr("IF(toxic = 1, 0, n)")).alias("q"))
        near: Counter = Counter()
        for r in spelled.where("q > 0").collect():  # words of the sample
            near[r["term"]] += 1
            own = math.log((r["p"] + 1) / (n_pos + 1)) - math.log((r["q"] + 1) / (n_neg + 1))
            lex.forms[r["form"]] = MISSPELLED * min(lex.weights[r["term"]], own) if own >= 2 else 0.0
        lex.plain = {t for t, n in near.items() if n >= NEIGHBOURS}

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = []
                for _, texts in by_size(batch.column(0)):
                    low = [(t or "").lower() for t in texts]
                    x += [evidence(t, h, lex) for t, h in zip(low, hits(low, lex), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.float64()), batch.column(1)], ["x", "toxic"])

        xy = sample.mapInArrow(sums, "x double, toxic int").toPandas()
    finally:
        sample.unpersist()
    x, y = xy["x"].to_numpy(), xy["toxic"].to_numpy(dtype=float)
    lex.base = float((y[x == 0].sum() + 1) / ((x == 0).sum() + 2))
    none = np.zeros(max(3, int(0.05 * (x > 0).sum())))  # so that the curve starts low
    lex.curve = logistic(np.append(x[x > 0], none), np.append(y[x > 0], none))
    return lex


def score(docs: DataFrame, lex: Lexicon, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """row: a struct of the columns to keep (all, unless named); score, n_hits and predicted."""
    row = F.struct(*([F.col(f"`{c}`") for c in keep] if keep else ["*"])).alias("row")
    kind = docs.select(row).schema["row"].dataType
    inside = kind.names.index(text) if kind.names.count(text) == 1 else None  # the text goes to the worker once
    shared = docs.sparkSession.sparkContext.broadcast(lex)  # bounded by the sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_states()
        own = shared.value
        slope, offset = own.curve
        for batch in batches:
            for at, texts in by_size(batch.column(1) if inside is None else batch.column(0).field(inside)):
                low = [(t or "").lower() for t in texts]
                found = hits(low, own)
                x = [evidence(t, h, own) for t, h in zip(low, found, strict=True)]
                x = [1 / (1 + math.exp(-max(-40.0, min(40.0, slope * e + offset)))) if e else own.base for e in x]
                columns = [batch.column(0).slice(at, len(texts)), pa.array(x, pa.float64()), pa.array([len(h) for h in found], pa.int32()), pa.array([int(v >= 0.5) for v in x], pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, ["row", "score", "n_hits", "predicted"])

    given = [row] if inside is not None else [row, F.col(f"`{text}`").alias("text")]
    return docs.select(*given).mapInArrow(run, beside(kind, "score double, n_hits int, predicted int"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    learn = lambda df: df.where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    lex = fit(learn(docs), learn(table(spark, sf_dir, "labels")))
    held_out = F.coalesce(F.crc32(F.col("row.doc_id").cast("string")) % 5 == 0, F.lit(False))
    return score(docs, lex, keep=["doc_id"]).select("row.doc_id", held_out.alias("held_out"), "score", "predicted", "n_hits")
