"""Pages with template residue, filler, messages of failure or requests for scripts in place of content.

A regularised logistic model on hashed n-grams, length and title features, which alone decides. Its weak labels
come from voters: the response status that quality flags report, placeholder syntax, nonsense Latin, stub values
and phrases of messages on short pages. How far each is to be trusted is estimated from how they agree, and their
votes become a probability for each page. The model is fitted on a bounded sample of pages and validated on
sites that the fit has not seen. Every page is then scored, on whole texts.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.main_body import body_flags
from weftline.llm.pages import Page, line_weights, page_lines, page_of, weight, with_marks
from weftline.session import Scratch

SAMPLE = 16_000  # pages that the label model, the fit and its validation may see together
ODD = 24_000  # pages with odd tokens that they may see beside these
QUIET = 4_000  # of them, at most, without a vote and without odd tokens, that the fit sees
DIMENSIONS = 1 << 19  # of the hashed features; the upper half is for words of longer pages, which count SOFT
SOFT = 0.05
PENALTY = 1e-4  # of the squared weights
RATE = 0.1  # of the first gradient steps
THRESHOLD = 0.5
DOUBT = 0.05  # of a page for which one rule votes
UNSEEN = 0.02  # of pages without a vote are failures, before their status is seen
SHORT = 400  # weighted characters of text below which a page's words are told apart from those of longer ones

# Syntaxes of unfilled placeholders.
PLACEHOLDER = re.compile(
    r"\{\{\{?[^{}\n]{1,60}\}?\}\}|\{%[^%\n]{1,60}%\}|<%=?[^%\n]{1,60}%>|[$#]\{[^{}\n]{1,60}\}|\[\[[^\[\]\n]{1,60}\]\]|\[%[^%\n]{1,60}%\]"
    r"|\*\|[\w.:]{1,40}\|\*|(?<![\w%])%[A-Za-z_][\w.]{1,39}%(?!\w)|(?<!\w)__[A-Za-z][\w.]*?__(?!\w)|@Model\.\w+|\bTODO:\s?\w+|\[(?:Insert|Your|Enter|Add|Write)\s[^\[\]\n]{1,60}\]"
    r"|<<[\w. ]{1,40}>>|<[A-Za-z][\w.]*>|(?<![\w$#{])\{[A-Za-z_0-9][\w.]{0,39}\}(?!\})"
)
# Payloads or lines that stand for a missing value.
STUB = re.compile(r"\W*(?:null|none|nan|nil|undefined|n/?a|tbd|tba|todo|object object|not[- ]?implemented|content|empty|error)\W*", re.I)
# Phrases of messages, by which pages without prose are labelled.
PHRASES = re.compile(
    r"not found|no encontrada|introuvable|nicht gefunden|見つかりません|no longer exists|has moved|link is broken|was removed|trail ends here"
    r"|\b(?:error|http|status)\s?[45]\d\d\b|^\W*[45]\d\d\b|service unavailable|bad gateway|gateway timeout|internal error|erreur interne|interner fehler|error interno|fatal:|went wrong|could not (?:connect|complete)"
    r"|denied|forbidden|verweigert|no tiene permiso|accès refusé|unusual traffic|too many requests|you are a (?:person|human)|checking your (?:connection|browser)|just a moment|アクセスが集中|session has (?:ended|expired)|not (?:offered|available) in your"
    r"|for maintenance|under maintenance|wartungsarbeiten|en maintenance|en mantenimiento|メンテナンス"
    r"|javascript (?:is|and cookies)|(?:enable|activer|active|aktivieren sie|activate) javascript|スクリプトを有効|scripts? (?:are|is|in your)|run scripts|allow scripts|scripting"
    r"|lorem ipsum|placeholder|your text|sample (?:heading|text|page)|coming soon|click to edit|edit (?:or delete|in settings)|replace this|add a short|default description|texte à remplacer|steht ihr text|escriba aquí|本文を入力|of your new site",
    re.I,
)
# Fixed value: the passage that filler in nonsense Latin is made of; words count as its own by their first three letters.
FILLER = (
    "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua ut enim ad minim veniam quis"
    " nostrud exercitation ullamco laboris nisi ut aliquip ex ea commodo consequat duis aute irure dolor in reprehenderit in voluptate velit esse cillum dolore"
    " eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt in culpa qui officia deserunt mollit anim id est laborum"
)
_STEMS = frozenset(w[:3] for w in FILLER.split() if len(w) > 2)
_ODD = re.compile(r"[{}<>\[\]%@#$*|_]|TODO")
_SHAPE = (re.compile(r"[^\W\d_]+(?:[._][^\W\d_]+)*"), re.compile(r"\d+"))
_WORDS = re.compile(r"[぀-ヿ㐀-鿿]{1,4}|[^\W\d_]+|\d+")
_NUMBERED = re.compile(r"(?<![\w$#{])\{\d+\}(?!\})")


def _slot(feature: str) -> int:
    return zlib.crc32(feature.encode()) & (DIMENSIONS // 2 - 1)


class _Slots(dict):
    """Slots of features met before, up to a bound."""

    def __missing__(self, feature: str) -> int:
        if len(self) > 300_000:
            self.clear()
        slot = self[feature] = _slot(feature)
        return slot


class _SoftSlots(dict):
    """Slots of the words of longer pages met before, up to a bound."""

    def __missing__(self, word: str) -> int:
        if len(self) > 300_000:
            self.clear()
        slot = self[word] = _slot("f " + word) + DIMENSIONS // 2
        return slot


_SLOTS, _SOFT = _Slots(), _SoftSlots()


def shape(token: str) -> str:
    """A token with runs of letters, dotted ones too, and of digits each made one sign, without punctuation around it."""
    return _SHAPE[1].sub("#", _SHAPE[0].sub("a", token.strip(".,;:!?()\"'…。、")))


def own_texts(page: Page, plain: str | None, notice: str) -> list[str]:
    """The body's lines without sample code; where there are none, what the page says without scripts.

    In lines that are links to other pages or remarks, the site's visitors or other pages speak; they aren't the page's own.
    """
    prose = plain.split("\n") if plain is not None else None
    weights = line_weights(page)
    lines = zip(page.texts, page.code, body_flags(page, weights), weights)
    texts = [(prose[i] or t) if prose else t for i, (t, c, b, w) in enumerate(lines) if b and not c and w == 1.0]
    return texts or ([notice] if notice else [])


def describe(title: str, texts: list[str]) -> list[int]:
    """Feature slots of a page: words and pairs of them, odd tokens by shape with their neighbours, length and title. Repeated ones count once."""
    size = sum(map(weight, texts))
    kind = "b" if size < SHORT else "f"
    found: set[str] = {f"size {min(14, size.bit_length())}", f"lines {kind} {min(6, len(texts).bit_length())}"}
    soft: set[str] = set()
    for text in texts:
        low = text.lower()
        if kind == "b":
            words = ["#" if w.isdigit() else w for w in _WORDS.findall(low)]
            found.update(f"b {w}" for w in words)
            found.update(f"b {a} {b}" for a, b in zip(words, words[1:]))
            found.add(f"b line {words[0]} {words[-1]} {len(words)}" if words and len(words) < 4 else "b line")
        else:
            soft.update(low.split())
        if _ODD.search(text):
            tokens = text.split()
            for i, token in enumerate(tokens):
                if _ODD.search(token):
                    form = shape(token)
                    before = shape(tokens[i - 1]) if i and _ODD.search(tokens[i - 1]) else _SHAPE[1].sub("#", tokens[i - 1].lower()) if i else "^"
                    after = shape(tokens[i + 1]) if i + 1 < len(tokens) and _ODD.search(tokens[i + 1]) else _SHAPE[1].sub("#", tokens[i + 1].lower()) if i + 1 < len(tokens) else "$"
                    found.update((f"s {form}", f"s {before} {form}", f"s {form} {after}", f"sw {_SHAPE[1].sub('#', token.lower())}"))
                    found.update(f"c {form[k : k + 3]}" for k in range(len(form) - 2))
    if title:
        if kind == "b":
            found.update(f"t {'#' if w.isdigit() else w}" for w in _WORDS.findall(title.lower()))
        found.add(f"title {kind} {title in texts}")
    return sorted({_SLOTS[f] for f in found} | {_SOFT[w] for w in soft})


def is_filler(text: str) -> bool:
    """Whether most words of a text are nonsense Latin."""
    words = [w for w in text.lower().split() if len(w) > 2]
    return len(words) >= 5 and sum(w[:3] in _STEMS for w in words) >= 0.6 * len(words)


#: Voters, beside the response status.
VOTERS = ("placeholder", "numbers", "filler", "stub", "phrase")


def votes(texts: list[str]) -> tuple[list[bool], list[tuple[str, str]]]:
    """What each voter says of a page, and its numbers in braces with the words around them.

    Placeholders with a name vote; numbers in braces vote only by `numbered`. Stubs and phrases vote where the page has no more than a message's text.
    """
    named, numbers = False, []
    for text in texts:
        if _ODD.search(text):
            for m in PLACEHOLDER.finditer(text):
                if _NUMBERED.fullmatch(m.group()):
                    before, after = text[: m.start()].split(), text[m.end() :].split()
                    around = " ".join([*before[-2:], "{}", *after[:2]])
                    numbers.append((_SHAPE[1].sub("#", around.lower()), m.group()))
                else:
                    named = True
    size = sum(map(weight, texts))
    few = size < SHORT
    return [named, False, any(len(t) >= 40 and is_filler(t) for t in texts), few and any(STUB.fullmatch(t) for t in texts), few and any(PHRASES.search(t) for t in texts)], numbers


def numbered(pages: list[list[tuple[str, str]]]) -> list[bool]:
    """Whether a page's numbers in braces are unfilled: a number that varies between the same words is filled in."""
    seen: dict[str, set[str]] = defaultdict(set)
    for numbers in pages:
        for around, number in numbers:
            seen[around].add(number)
    return [any(len(seen[around]) < 3 for around, _ in numbers) for numbers in pages]


def agreed(flag: np.ndarray, known: np.ndarray, said: np.ndarray) -> np.ndarray:
    """The probability of each page to be a failure.

    Each rule that votes halves the doubt twice and more (DOUBT); pages without a vote start at UNSEEN. The response status
    then counts by its own rates, which are estimated: how often it reports pages with and without votes.
    """
    odds = np.where(said.any(axis=1), (1 - DOUBT) / DOUBT * 3.0 ** np.maximum(0, said.sum(axis=1) - 1), UNSEEN / (1 - UNSEEN))
    some = said.any(axis=1)
    yes, no = ((flag & known & s).sum() + 0.5 for s in (some, ~some))
    yes, no = yes / ((known & some).sum() + 1.0), no / ((known & ~some).sum() + 1.0)
    reported = max(1.0, yes / no)
    silent = min(1.0, (1 - yes) / (1 - no))
    odds = odds * np.where(known, np.where(flag, reported, silent), 1.0)
    return odds / (1 + odds)


class Logistic:
    """Logistic regression with an L2 penalty on sparse rows of 0/1 features, by gradient steps of adaptive size for each weight."""

    def __init__(self, penalty: float = PENALTY, steps: int = 150) -> None:
        self.penalty, self.steps = penalty, steps
        self.weights = np.zeros(DIMENSIONS, np.float32)
        self.bias = 0.0

    def fit(self, rows: list, labels: np.ndarray) -> Logistic:
        """Labels are probabilities. Both classes weigh alike. Without rows of both classes the model says no to everything."""
        positive = float(labels.sum())
        if not len(labels) or labels.max() < 0.5 or labels.min() >= 0.5:
            self.bias = -20.0
            return self
        flat = np.concatenate([np.asarray(r, np.int64) for r in rows])
        used, flat = np.unique(flat, return_inverse=True)
        owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        value = np.where(used < DIMENSIONS // 2, 1.0, SOFT)
        scale = labels * 0.5 / positive + (1 - labels) * 0.5 / (len(labels) - positive)
        w, first, second = (np.zeros(len(used) + 1) for _ in range(3))
        for t in range(1, self.steps + 1):
            z = np.bincount(owner, (w[:-1] * value)[flat], len(rows)) + w[-1]
            off = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels) * scale
            slope = np.append(np.bincount(flat, off[owner], len(used)) * value + self.penalty * w[:-1], off.sum())
            first = 0.9 * first + 0.1 * slope
            second = 0.99 * second + 0.01 * slope**2
            w -= RATE * (1 - t / (self.steps + 1)) * first / (1 - 0.9**t) / (np.sqrt(second / (1 - 0.99**t)) + 1e-9)
        self.weights[used] = w[:-1] * value
        self.bias = float(w[-1])
        return self

    def score(self, slots: list[int]) -> float:
        z = float(self.weights[np.asarray(slots, np.int64)].sum()) + self.bias if len(slots) else self.bias
        return float(1 / (1 + np.exp(-max(-30.0, min(30.0, z)))))


_OWN = pa.schema([("raw_id", pa.int64()), ("site", pa.string()), ("title", pa.string()), ("text", pa.string())])


def _own_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(raw_id, site, title, text) of pages, a slice at a time, so that no more is in Python's objects; text is null where a page has none of its own."""
    for batch in batches:
        for lo in range(0, batch.num_rows, 256):
            part = batch.slice(lo, 256)
            rows = []
            for raw_id, host, title, notice, plain, *record in zip(*(part.column(i).to_pylist() for i in range(10))):
                texts = own_texts(page_of(*record), plain, notice or "")
                rows.append((raw_id, host, title or "", "\n".join(texts) if texts else None))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _OWN)], schema=_OWN)


def _texts(text: str | None) -> list[str]:
    return [] if text is None else text.split("\n")


def _sample_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = (pa.int64(), pa.string(), pa.bool_(), pa.list_(pa.int32()), pa.list_(pa.bool_()), pa.list_(pa.list_(pa.string())), pa.bool_())
    for batch in batches:
        rows = []
        for raw_id, host, title, text, flag in zip(*(batch.column(i).to_pylist() for i in range(5))):
            texts = _texts(text)
            said, numbers = votes(texts)
            rows.append((raw_id, host, flag, describe(title, texts), said, [list(n) for n in numbers], any(_ODD.search(t) for t in texts)))
        columns = list(zip(*rows)) if rows else [[]] * 7
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["raw_id", "site", "flag", "slots", "said", "numbers", "odd"])


class FailurePages:
    """The classifier and its verdicts on all pages of `raw`.

    Blank payloads and rows without raw_id are no pages. `flags` may repeat or lack rows; its clear_failure_union is
    the response status. The fit sees pages drawn by the hash of their id: `sample` of all about, and ODD of those with
    signs that placeholders are made of, which are few.
    """

    def __init__(self, spark: SparkSession, raw: DataFrame, flags: DataFrame, sample: int = SAMPLE) -> None:
        keep = Scratch(spark, "failures")
        pages = keep.put(page_lines(raw))
        columns = ("page_id", "site", "title", "notice", "plain", "lines", "meta", "keys", "leads", "marks")
        self.rows = keep.put(with_marks(pages, *columns[1:5]).select(*columns).mapInArrow(_own_batches, "raw_id BIGINT, site STRING, title STRING, text STRING"))
        keep.drop(pages)
        odd = F.coalesce(F.col("text").rlike(_ODD.pattern), F.lit(False))
        total, odds = self.rows.agg(F.count(F.lit(1)), F.count_if(odd)).collect()[0]
        whole = 1_000_000
        part = lambda most, n: max(1, min(whole, int(whole * most / max(1, n))))
        drawn = F.pmod(F.xxhash64(F.lit("sample"), "raw_id"), F.lit(whole))
        some = (drawn < part(sample, total)) | odd & (drawn < part(ODD, odds))
        status = flags.groupBy("raw_id").agg(F.max("clear_failure_union").alias("flag"))
        seen = self.rows.where(some).join(status, "raw_id", "left").select("raw_id", "site", "title", "text", "flag")
        ddl = "raw_id BIGINT, site STRING, flag BOOLEAN, slots ARRAY<INT>, said ARRAY<BOOLEAN>, numbers ARRAY<ARRAY<STRING>>, odd BOOLEAN"
        found = seen.mapInArrow(_sample_batches, ddl).toArrow()
        column = {n: found.column(n).to_pylist() for n in found.column_names}
        order = sorted(range(len(column["raw_id"])), key=lambda i: zlib.crc32(str(column["raw_id"][i]).encode()))
        column = {n: [c[i] for i in order] for n, c in column.items()}
        said = np.array(column["said"], bool).reshape(-1, len(VOTERS))
        said[:, 1] = numbered([[tuple(n) for n in page] for page in column["numbers"]])
        flag = np.array([f is True for f in column["flag"]], bool)
        known = np.array([f is not None for f in column["flag"]], bool)
        labels = agreed(flag, known, said)
        quiet = ~(said.any(axis=1) | np.array(column["odd"], bool))
        fit = ~quiet | (np.cumsum(quiet) <= QUIET)
        held = np.array([zlib.crc32(b"held " + str(s).encode()) % 5 == 0 for s in column["site"]], bool)
        rows = column["slots"]
        pick = lambda mask: ([rows[i] for i in np.flatnonzero(mask)], labels[mask])
        self._unseen = lambda: self._validate(Logistic().fit(*pick(fit & ~held)), *pick(held), len({s for s, h in zip(column["site"], held) if h}))
        self.model = Logistic().fit(*pick(fit))

    @property
    def validation(self) -> dict[str, float]:
        """How a fit without a fifth of the sites does on their pages, against the labels that the voters agree on."""
        return self._unseen()

    @staticmethod
    def _validate(model: Logistic, rows: list, labels: np.ndarray, sites: int) -> dict[str, float]:
        said = np.array([model.score(r) for r in rows]) >= THRESHOLD
        true = labels >= 0.5
        right = float((said & true).sum())
        return {
            "sites": float(sites), "pages": float(len(labels)), "failures": float(true.sum()),
            "precision": right / said.sum() if said.any() else 1.0, "recall": right / true.sum() if true.any() else 1.0,
        }

    def scored(self) -> DataFrame:
        """(raw_id, score, failed) of every page; the model's score alone decides."""
        used = np.flatnonzero(self.model.weights)
        weights, bias = (used, self.model.weights[used]), self.model.bias

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model = Logistic()
            model.weights[weights[0]], model.bias = weights[1], bias
            for batch in batches:
                scores = [model.score(describe(title, _texts(text))) for title, text in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
                failed = [s >= THRESHOLD for s in scores]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array(failed, pa.bool_())], names=["raw_id", "score", "failed"])

        return self.rows.select("raw_id", "title", "text").mapInArrow(run, "raw_id BIGINT, score DOUBLE, failed BOOLEAN")
