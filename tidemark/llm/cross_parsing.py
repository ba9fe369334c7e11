"""Language identification by cross-parsing entropy.

For each language a suffix automaton is built over a bounded sample of labelled text. A new text is parsed greedily
into the longest phrases that occur in that sample: the automaton is followed until no transition is left, which ends
a phrase; a letter that the sample lacks is a phrase of its own. The language that needs the fewest phrases per
character wins.

Thousands of texts are parsed at once with numpy: one step moves every piece of a batch by one character. Whole texts
are parsed, and exactly: a long text is dealt in pieces that are all parsed at once as if each began a phrase, and then
once more from the state the piece before has ended in, only until that parse meets the first one, which two greedy
parses of the same text soon do. All letters of the samples are symbols: the commonest have columns of a dense table of
transitions, the others are found by binary search.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm._base import append_columns, importable

#: Bounds of the sample: texts drawn for a language, characters used for one and for all languages together.
SAMPLE_TEXTS = 400
SAMPLE_CHARS = 40_000
SAMPLE_CHARS_ALL = 240_000
#: Columns of the dense tables
DENSE = 64
#: Characters of a piece that is parsed side by side with others
PIECE = 1024


def has_letter(text: str) -> bool:
    """Whether any character is a letter (categories L*); numbers such as fractions and Roman numerals are none."""
    return any(map(str.isalpha, text))


class Alphabet:
    """All lower-cased letters of the samples as symbols, the commonest first. Runs of other characters are one
    separator, 0, so that mark-up and punctuation say nothing about the language; letters that no sample has are the
    last symbol, ``size - 1``."""

    def __init__(self, texts: list[str]):
        codes, counts = np.unique(np.concatenate([np.frombuffer(t.lower().encode("utf-32-le", "replace"), "<u4") for t in texts]), return_counts=True)
        keep = [int(c) for c in codes[np.lexsort((codes, -counts))] if chr(c).isalpha()]
        self.size = len(keep) + 2
        self.table = np.array([self.size - 1 if chr(c).isalpha() else 0 for c in range(0x110000)], np.uint16 if self.size < 1 << 16 else np.uint32)
        for s, c in enumerate(keep, 1):
            self.table[c] = s
            up = chr(c).upper()
            if len(up) == 1:
                self.table[ord(up)] = s

    def encode(self, text: str) -> np.ndarray:
        s = self.table[np.frombuffer(text.encode("utf-32-le", "replace"), "<u4")]
        return s[np.append(True, (s[1:] != 0) | (s[:-1] != 0))] if len(s) else s


def suffix_automaton(symbols: np.ndarray) -> list[dict[int, int]]:
    """Transitions of the states of the suffix automaton of a sequence; state 0 is the root."""
    to: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for c in symbols.tolist():
        cur = len(to)
        to.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p != -1 and c not in to[p]:
            to[p][c] = cur
            p = link[p]
        if p != -1:
            q = to[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(to)
                to.append(dict(to[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p != -1 and to[p].get(c) == q:
                    to[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return to


class Parser:
    """Greedy parsing by one automaton. A move is twice the next state, plus 1 where the symbol begins a new phrase.

    The last state is the one between phrases: it has no transition, so any symbol begins a phrase there.
    """

    def __init__(self, symbols: np.ndarray, alphabet: int):
        to = suffix_automaton(symbols)
        self.size, self.between = alphabet, len(to)
        self.fresh = np.full(alphabet, 2 * self.between + 1, np.int64)  # the move of a symbol that begins a phrase
        for c, s in to[0].items():
            self.fresh[c] = 2 * s + 1
        self.dense = np.tile(self.fresh[np.minimum(np.arange(DENSE), alphabet - 1)], (self.between + 1, 1)).astype(np.int32)
        rare = []
        for state, moves in enumerate(to):
            for c, s in moves.items():
                if c < DENSE - 1:
                    self.dense[state, c] = 2 * s
                else:
                    rare.append((state * alphabet + c, 2 * s))
        rare.sort()
        self.dense = self.dense.ravel()
        self.keys, self.moves = np.array([k for k, _ in rare], np.int64), np.array([m for _, m in rare], np.int64)

    def step(self, state: np.ndarray, symbol: np.ndarray, rare: bool) -> np.ndarray:
        """Moves from states by symbols; ``rare`` tells whether any symbol may have no column."""
        if not rare:
            return self.dense[state * DENSE + symbol]
        got = self.dense[state * DENSE + np.minimum(symbol, DENSE - 1)]
        far = np.flatnonzero(symbol >= DENSE - 1)
        move = self.fresh[symbol[far]]
        if len(self.keys):
            key = state[far].astype(np.int64) * self.size + symbol[far]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            move = np.where(self.keys[at] == key, self.moves[at], move)
        got[far] = move
        return got


def _parse(parser: Parser, grid: np.ndarray, live: np.ndarray, rare: np.ndarray, size: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Phrases that begin in each piece. ``grid[t, i]`` is symbol t of piece i, pieces in descending ``size``; ``live``
    says how many have a symbol t, ``before`` which piece comes before each in its text (-1: none)."""
    n = len(size)
    states = np.full((len(grid) + 1, n), parser.between, np.int32)
    begun = np.zeros((len(grid) + 1, n), np.int16)
    for t, row in enumerate(grid):
        m = live[t]
        got = parser.step(states[t, :m], row[:m], rare[t])
        states[t + 1, :m] = got >> 1
        begun[t + 1, :m] = begun[t, :m] + (got & 1)
    end = states[size, np.arange(n)]
    count = begun[size, np.arange(n)].astype(np.int64)
    # once more, from where the piece before has ended; again for those whose predecessor then ends elsewhere
    entered = np.full(n, parser.between, np.int32)
    todo = np.flatnonzero(before >= 0)
    while len(todo := todo[entered[todo] != end[before[todo]]]):
        at, state = todo, end[before[todo]]
        entered[todo] = state
        made = np.zeros(len(at), np.int64)
        for t in range(len(grid)):
            got = parser.step(state, grid[t, at], rare[t])
            state, made = got >> 1, made + (got & 1)
            met, over = state == states[t + 1, at], size[at] == t + 1
            if met.any():
                count[at[met]] = made[met] + begun[size[at[met]], at[met]] - begun[t + 1, at[met]]
                end[at[met]] = states[size[at[met]], at[met]]
            if (done := over & ~met).any():
                count[at[done]], end[at[done]] = made[done], state[done]
            going = ~(met | over)
            at, state, made = at[going], state[going], made[going]
            if not len(at):
                break
        todo = np.flatnonzero(before >= 0)
    return count


class Model:
    """Automata of all languages over one alphabet."""

    def __init__(self, samples: dict[str, str]):
        self.langs = sorted(samples)
        self.alphabet = Alphabet(list(samples.values())) if samples else None
        self.parsers = [Parser(self.alphabet.encode(samples[x]), self.alphabet.size) for x in self.langs]

    def phrases(self, texts: list[str]) -> np.ndarray:
        """Phrases that each text needs in each language; shape (texts, languages)."""
        out = np.zeros((len(texts), len(self.langs)), np.int64)
        codes, owner, first = [], [], []
        for i, t in enumerate(texts):
            c = self.alphabet.encode(t)
            for a in range(0, len(c), PIECE):
                codes.append(c[a : a + PIECE])
                owner.append(i)
                first.append(a == 0)
        if not codes:
            return out
        size = np.array([len(c) for c in codes])
        order = np.argsort(-size, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        before = np.where(first, -1, np.roll(rank, 1))[order]
        grid = np.zeros((len(codes), int(size.max())), codes[0].dtype)
        for row, k in enumerate(order):
            grid[row, : size[k]] = codes[k]
        grid, size = np.ascontiguousarray(grid.T), size[order]
        live = np.searchsorted(-size, -np.arange(len(grid)), side="left")  # pieces longer than t
        rare = grid.max(axis=1) >= DENSE - 1
        for k, parser in enumerate(self.parsers):
            np.add.at(out[:, k], np.array(owner)[order], _parse(parser, grid, live, rare, size, before))
        return out


def learn(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id") -> Model:
    """Fit on a bounded sample: about ``SAMPLE_TEXTS`` texts of each language, drawn by the hash of their key and text.
    Each gives one piece at a place drawn by hash, an equal share of ``SAMPLE_CHARS`` (less if there are many
    languages, see ``SAMPLE_CHARS_ALL``), so no single text fills a sample, however long it is.

    Rows with null language or without a letter are not used. One aggregation counts texts per language; the sample is
    then a filter on the hash, with no sort, and only the pieces come to the driver.
    """
    usable = docs.where(F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}")).select(F.col(lang).alias("l"), F.col(text).alias("t"), F.xxhash64(F.coalesce(F.col(key).cast("string"), F.lit("")), F.col(text)).alias("h"))
    counts = {r["l"]: r["n"] for r in docs.where(F.col(lang).isNotNull()).groupBy(F.col(lang).alias("l")).agg(F.count("*").alias("n")).collect()}
    if not counts:
        return Model({})
    most = max(2_000, min(SAMPLE_CHARS, SAMPLE_CHARS_ALL // len(counts)))
    sizes = F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(max(1, most // min(n, SAMPLE_TEXTS))))])
    limits = F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(int(min(1.0, SAMPLE_TEXTS / n) * (1 << 30))))])
    drawn = usable.where(F.pmod("h", F.lit(1 << 30)) < F.element_at(limits, F.col("l"))).withColumn("n", F.element_at(sizes, F.col("l")))
    begin = F.pmod(F.xxhash64("h"), F.greatest(F.lit(1), F.length("t") - F.col("n") + 1)).cast("int") + 1
    samples: dict[str, str] = {}
    for r in sorted(drawn.select("l", "h", F.substring("t", begin, F.col("n")).alias("t")).collect(), key=lambda r: (r["l"], r["h"], r["t"])):
        samples[r["l"]] = samples.get(r["l"], "") + "\n" + r["t"]
    return Model({k: v for k, v in samples.items() if has_letter(v)})


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Every row with ``lang_pred``, ``score`` and ``phrases_per_char`` (map of language to phrases per character).

    ``und`` with score 0 if the text is null, empty or has no letter, or if no language was learned. The score is the
    runner-up's share of the phrases of the best two (0.5: no difference, towards 1: certain); equal counts go to the
    alphabetically first language. Texts of any length are parsed whole; repeated rows are judged alike. Columns of
    these names are replaced; an empty table gives an empty result.
    """
    importable(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(texts: list) -> tuple:
        m = sent.value
        pred, score, rates = ["und"] * len(texts), np.zeros(len(texts)), [None] * len(texts)
        use = [i for i, t in enumerate(texts) if m.langs and t and has_letter(t)]
        n = m.phrases([texts[i] for i in use]) if use else []
        for i, row in zip(use, n, strict=True):
            best = int(row.argmin())
            rest = np.delete(row, best)
            pred[i], score[i] = m.langs[best], (rest.min() / (rest.min() + row[best])) if len(rest) else 1.0
            rates[i] = [(x, float(v) / len(texts[i])) for x, v in zip(m.langs, row, strict=True)]
        return pred, score, pa.array(rates, pa.map_(pa.string(), pa.float64()))

    return append_columns(docs, [text], "lang_pred string, score double, phrases_per_char map<string,double>", run, part=4_000_000)
