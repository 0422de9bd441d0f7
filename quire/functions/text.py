"""Text functions: normalisation, names, verdicts, subjects, similarity.

Everything that Spark can express is a column expression; compatibility
decomposition and the longest-common-subsequence ratio are Arrow-backed pandas
UDFs, because no built-in has the same result.
"""

from __future__ import annotations

import unicodedata
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.runtime import vectorised

# Particles that belong to the surname that follows them.
PARTICLES = (
    "van", "von", "de", "der", "den", "di", "da", "das", "dos", "del",
    "della", "la", "le", "du", "bin", "ibn", "al", "el", "ter", "ten",
)
# First words of titles that say nothing about the subject.
FIRST_WORD_STOPWORDS = (
    "a", "an", "the", "on", "in", "for", "of", "towards", "toward", "from",
    "via", "with", "by", "to", "at", "novel", "new",
)
# reviewers' confidence, on a scale from 1 to 4.
CONFIDENCE_LEVELS = {
    "not confident": 1,
    "somewhat confident": 2,
    "confident but not absolutely certain": 3,
    "very confident": 4,
}
# Verdicts from worst to best; the accept side begins at rank 3.
VERDICT_ORDER = ("Strong Reject", "Reject", "Weak Reject", "Weak Accept", "Accept", "Strong Accept")
# Subjects that are dropped (whatever their case) and renamed.
SUBJECT_DROP = ("other", "deep learning")
SUBJECT_ALIASES = {
    "CT": "CT / X-Ray",
    "X-Ray": "CT / X-Ray",
    "Computer Aided Diagnosis, Treatment Response, and Outcome Prediction": "Computer Aided Diagnosis",
    "Image Formation and Reconstruction": "Image Reconstruction",
    "Transfer learning": "Transfer Learning",
    "Data efficient Learning": "Data Efficient Learning",
    "Model Generalizability": "Model Generalizability / Federated Learning",
    "Heart": "Cardiac",
    "Semi-/Weakly-/Un-/Self-supervised representation learning": "Semi-/Weakly-/Self-supervised Learning",
    "Semi-/Weakly-/Un-/Self-supervised Representation Learning": "Semi-/Weakly-/Self-supervised Learning",
    "Semi- / Weakly- / Self-supervised Learning": "Semi-/Weakly-/Self-supervised Learning",
    "Self-supervised learning": "Semi-/Weakly-/Self-supervised Learning",
    "Semi-supervised learning": "Semi-/Weakly-/Self-supervised Learning",
    "Weakly supervised learning": "Semi-/Weakly-/Self-supervised Learning",
    "CT / X-ray": "CT / X-Ray",
    "Computer-Aided Diagnosis": "Computer Aided Diagnosis",
    "Computational / Integrative Pathology": "Computational (Integrative) Pathology",
    "Computational Anatomy & Physiology": "Computational Anatomy and Physiology",
    "Fetal / Pediatric": "Fetal / Pediatric Imaging",
    "Diffusion MRI": "MRI - Diffusion Imaging",
    "Functional MRI": "MRI - Functional MRI",
    "Nuclear Imaging / PET / SPECT": "Nuclear Imaging",
    "Uncertainty Quantification": "Uncertainty",
    "Planning & Simulation": "Planning and Simulation",
    "Data Science in Surgery": "Data Science",
    "Telemedicine & Mobile Health Imaging": "Telemedicine and Mobile Health Imaging Technologies",
    "Low-Cost / Point-of-Care Imaging": "Low-Cost and Point-of-Care Imaging Solutions",
    "Lung / Thoracic": "Lung",
}
# Topics and the case-insensitive patterns any of which marks them.
BUZZWORDS = {
    "Segmentation": [r"\bsegment"],
    "Diffusion models": [r"diffusion model", r"\bddpm\b", r"score.based generat"],
    "Foundation models": [r"foundation model"],
    "Transformers / ViT": [r"\btransformer\b", r"\bvit\b", r"\bswin\b"],
    "Self-supervised / SSL": [r"self.?supervised", r"\bcontrastive learn"],
    "Semi-supervised": [r"semi.?supervised"],
    "Domain adaptation": [r"domain adapt"],
    "Federated learning": [r"\bfederated\b"],
    "Vision-language / VLM": [r"vision.?language", r"\bvlm\b", r"\bclip\b"],
    "Large language model": [r"\bllm\b", r"large language model"],
    "Generative / GAN": [r"\bgenerative\b", r"\bgan\b"],
    "Image registration": [r"\bregistrat"],
    "Image reconstruction": [r"\breconstruct"],
    "Detection": [r"\bdetect"],
    "Classification": [r"\bclassif"],
    "Uncertainty": [r"\buncertain"],
    "Weakly supervised": [r"weakly.?supervised"],
    "Active learning": [r"active learn"],
    "Surgical AI": [r"\bsurgical\b", r"\blaparoscop", r"\bendoscop"],
    "Pathology / WSI": [r"\bpatholog", r"whole.?slide", r"\bwsi\b"],
    "Explainability": [r"\bexplainab", r"\binterpretab", r"\bxai\b"],
    "Multimodal": [r"multi.?modal"],
    "Mamba / SSM": [r"\bmamba\b", r"state.?space model"],
    "Segment Anything / SAM": [r"\bsam\b", r"segment anything"],
}


def _lookup(col: Column, values: dict[str, object]) -> Column:
    """Value of a fixed map, null where the key is missing."""
    table = F.create_map(*[x for k, v in values.items() for x in (F.lit(k), F.lit(v))])
    return F.get(F.transform(F.array(col), lambda k: F.try_element_at(table, k)), F.lit(0))


def clean(col: Column) -> Column:
    """Null for the empty string and for ``N/A``."""
    return F.when(~col.isin("", "N/A"), col)


def blank_to_null(col: Column) -> Column:
    return F.nullif(F.trim(col), F.lit(""))


@vectorised("string")
def nfkd(s: pd.Series) -> pd.Series:
    """Compatibility decomposition without combining marks."""
    def fold(x):
        return x if x is None or x.isascii() else "".join(c for c in unicodedata.normalize("NFKD", x) if not unicodedata.combining(c))

    return s.map(fold, na_action="ignore")


@vectorised("string")
def nfkd_casefold(s: pd.Series) -> pd.Series:
    """As ``nfkd``, with full case folding (sharp s becomes ss)."""
    def fold(x):
        return "".join(c for c in unicodedata.normalize("NFKD", x) if not unicodedata.combining(c)).casefold()

    return s.map(fold, na_action="ignore")


@vectorised("string")
def casefold(s: pd.Series) -> pd.Series:
    return s.str.casefold()


def _words_only(col: Column) -> Column:
    return F.trim(F.regexp_replace(col, "[^a-z0-9]+", " "))


def normalize_title(col: Column) -> Column:
    """Comparable form of a title: no accents, lower case, alphanumeric words."""
    return _words_only(F.lower(nfkd(col)))


def normalize_title_casefold(col: Column) -> Column:
    return _words_only(nfkd_casefold(col))


def searchable(col: Column) -> Column:
    """Lower-case search text without accents."""
    return F.lower(nfkd(F.coalesce(col, F.lit(""))))


def before_dash(col: Column) -> Column:
    """What stands before the first hyphen or dash, white space around it aside."""
    return F.trim(F.get(F.split(col, r"\s*[—–-]\s*", 2), F.lit(0)))


def verdict(col: Column) -> Column:
    """Verdict of a label with its case; null if there is none."""
    return F.nullif(before_dash(F.trim(col)), F.lit(""))


def verdict_lower(col: Column) -> Column:
    return F.lower(verdict(col))


def verdict_rank(col: Column) -> Column:
    """0 (strong reject) to 5 (strong accept), exact case; null otherwise."""
    return _lookup(col, {v: i for i, v in enumerate(VERDICT_ORDER)}).cast("int")


def accepts(rank: Column) -> Column:
    return rank >= 3


def confidence_level(col: Column) -> Column:
    return _lookup(F.trim(F.regexp_replace(F.lower(col), r"\s+", " ")), CONFIDENCE_LEVELS).cast("int")


def int_in_parens(col: Column) -> Column:
    return F.nullif(F.regexp_extract(col, r"\((\d+)\)", 1), F.lit("")).cast("int")


def bare_int(col: Column) -> Column:
    return F.nullif(F.regexp_extract(col, r"^\s*(\d+)\s*$", 1), F.lit("")).cast("int")


def label_without_score(col: Column) -> Column:
    """``(4) Weak accept, ...`` without its number."""
    return F.nullif(F.btrim(F.regexp_replace(col, r"\(\d+\)", ""), F.lit(" ,;:-")), F.lit(""))


def score_changed(pre: Column, post: Column) -> Column:
    """Whether the verdict after rebuttal is another; false without one."""
    given = post.isNotNull() & ~F.upper(F.trim(post)).isin("", "N/A")
    return F.coalesce(given & (verdict_lower(pre) != verdict_lower(post)), F.lit(False))


def append_block(*cols: Column) -> Column:
    """Blocks set apart by a blank line, nulls aside."""
    return F.nullif(F.concat_ws("\n\n", *cols), F.lit(""))


def short_subject(col: Column) -> Column:
    """After the first `` -> ``, else after the first `` - ``."""
    return (
        F.when(F.contains(col, F.lit(" -> ")), F.get(F.split(col, " -> ", 2), F.lit(1)))
        .when(F.contains(col, F.lit(" - ")), F.get(F.split(col, " - ", 2), F.lit(1)))
        .otherwise(col)
    )


def canonical_subject(col: Column) -> Column:
    """One name for a subject in all years; null for catch-alls."""
    short = F.trim(short_subject(col))
    return F.when(~F.lower(short).isin(*SUBJECT_DROP), F.coalesce(_lookup(short, SUBJECT_ALIASES), short))


def area_leaf(col: Column) -> Column:
    return F.trim(F.element_at(F.split(col, "->"), -1))


def word_count(col: Column) -> Column:
    t = F.trim(F.regexp_replace(col, r"\s+", " "))
    return F.when(t == "", 0).otherwise(F.size(F.split(t, " ")))


def first_word(col: Column) -> Column:
    """Lower-case first word without a colon at its end."""
    return F.rtrim(F.lower(F.get(F.split(F.trim(col), r"\s+"), F.lit(0))), F.lit(":"))


def any_pattern(col: Column, patterns: list[str]) -> Column:
    """Whether any of the (lower-case) patterns is found, whatever the case.

    Words are those of Unicode.  The text is lower-cased first, since matching
    without case is slower.
    """
    return F.lower(col).rlike("(?U)" + "|".join(f"(?:{p})" for p in patterns))


def chars_without_space(*cols: Column) -> Column:
    """Characters of several texts, white space and nulls aside."""
    lengths = [F.coalesce(F.char_length(F.regexp_replace(c, r"\s", "")), F.lit(0)) for c in cols]
    return sum(lengths[1:], lengths[0])


def speaker_surname(col: Column) -> Column:
    """Last token of the name before the first comma, normalised."""
    name = F.trim(F.get(F.split(col, ","), F.lit(0)))
    return F.nullif(normalize_title(F.element_at(F.split(name, r"\s+"), -1)), F.lit(""))


@vectorised("array<string>")
def author_surnames(authors: pd.Series) -> pd.Series:
    """Normalised surnames of ``Last, First`` names."""
    def one(names):
        out = set()
        for a in names if names is not None else ():
            s = "".join(c for c in unicodedata.normalize("NFKD", a.split(",")[0]) if not unicodedata.combining(c)).lower()
            s = " ".join("".join(c if c.isascii() and c.isalnum() else " " for c in s).split())
            if s:
                out.add(s)
        return sorted(out)

    return authors.map(one)


def last_first(col: Column) -> Column:
    """``First Last`` to struct(name ``Last, First``, rule): empty, single, or particle.

    The surname is the last token, and particles before it, but never the first token.
    """
    t = F.trim(F.regexp_replace(F.coalesce(col, F.lit("")), r"\s+", " "))
    parts = F.split(t, " ")
    n = F.size(parts)
    plain = F.transform(parts, lambda p: F.lower(F.replace(p, F.lit("."), F.lit(""))))
    # Walk back from the last token while the token before is a particle.
    back = F.aggregate(
        F.sequence(F.lit(0), F.greatest(n - 3, F.lit(0))), F.struct(F.lit(1).alias("k"), F.lit(True).alias("go")),
        lambda a, i: F.when(a["go"] & (n - 1 - a["k"] >= 1) & F.coalesce(F.get(plain, n - 1 - a["k"]).isin(*PARTICLES), F.lit(False)), F.struct((a["k"] + 1).alias("k"), F.lit(True).alias("go"))).otherwise(F.struct(a["k"].alias("k"), F.lit(False).alias("go"))),
    )["k"]
    k = F.least(back, n - 1)
    surname = F.array_join(F.slice(parts, n - k + 1, k), " ")
    given = F.array_join(F.slice(parts, F.lit(1), n - k), " ")
    return (
        F.when(t == "", F.struct(F.lit("").alias("name"), F.lit("empty").alias("rule")))
        .when(n == 1, F.struct(t.alias("name"), F.lit("single").alias("rule")))
        .otherwise(F.struct(F.concat(surname, F.lit(", "), given).alias("name"), F.lit("particle").alias("rule")))
    )


def join_lines(lines: Column) -> Column:
    """Wrapped lines as one text; a hyphen at a line's end keeps the next one close."""
    parts = F.filter(F.transform(lines, lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))), lambda x: x != "")
    return F.replace(F.replace(F.array_join(parts, "\n"), F.lit("-\n"), F.lit("-")), F.lit("\n"), F.lit(" "))


def presenter(col: Column) -> Column:
    """``Name, Affiliation, ..., Country`` as struct(name, affiliation, country)."""
    p = F.filter(F.transform(F.split(F.coalesce(col, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")
    n = F.size(p)
    return F.struct(
        F.get(p, F.lit(0)).alias("name"),
        F.when(n == 2, F.get(p, F.lit(1))).when(n > 2, F.array_join(F.slice(p, F.lit(2), n - 2), ", ")).alias("affiliation"),
        F.when(n > 2, F.element_at(p, -1)).alias("country"),
    )


def is_bold(font: Column) -> Column:
    return font.rlike(r"(?i)bold|black|bd$")


def is_italic(font: Column) -> Column:
    return font.rlike(r"(?i)italic|it$")


def thousands(col: Column) -> Column:
    return F.format_number(col, 0)


def indel_ratio(a: str, b: str) -> float:
    """200 times the longest common subsequence over both lengths; 100 if both are empty.

    Bit-parallel: a row of the dynamic program is one integer.
    """
    if not a and not b:
        return 100.0
    if len(a) > len(b):
        a, b = b, a
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & where.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    lcs = len(a) - row.bit_count()
    return 200.0 * lcs / (len(a) + len(b))


def _steps(values: list[np.ndarray], classes: int, levels: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts by class as 0 and 1, one column a level of a class, and how many are above the levels."""
    out = np.zeros((len(values), levels, classes), np.float32)
    rest = np.zeros(len(values))
    for i, v in enumerate(values):
        n = np.bincount(v % classes, minlength=classes)
        out[i] = n > np.arange(levels)[:, None]
        rest[i] = np.maximum(n - levels, 0).sum()
    return out.reshape(len(values), -1), rest


def _shared(a: list[np.ndarray], b: list[np.ndarray], classes: int, levels: int) -> np.ndarray:
    """At least the number of values that two lists have in common, for each pair of lists."""
    (x, p), (y, q) = _steps(a, classes, levels), _steps(b, classes, levels)
    return x @ y.T + np.minimum(p[:, None], q)


def ratio_bounds(a: list[str], b: list[str]) -> np.ndarray:
    """Upper bounds of ``indel_ratio``, one row for each of ``a``.

    A common subsequence of length L has no more of a character than either
    string.  Of its L - 1 steps at most m + n - 2 L pass over characters, and the
    others are adjacent pairs of both: these have at least 3 L - m - n - 1 pairs
    in common.  Characters and pairs are folded to classes, which can only raise
    what is shared.
    """
    x, y = ([np.frombuffer(s.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64) for s in t] for t in (a, b))
    m, n = np.array([len(v) for v in x])[:, None], np.array([len(v) for v in y])
    pairs = _shared([v[:-1] * 31 + v[1:] for v in x], [v[:-1] * 31 + v[1:] for v in y], 1024, 2)
    longest = np.minimum(np.minimum(m, n), np.minimum(_shared(x, y, 64, 8), np.floor((pairs + (m + n + 1)) / 3)))
    return np.where(m + n == 0, 100.0, 200.0 * longest / np.maximum(m + n, 1))


def _codes(a: list[str], b: list[str]) -> tuple[list[np.ndarray], list[np.ndarray], int]:
    """Characters of both lists as places in their common alphabet, and its size."""
    n = np.cumsum([len(s) for s in a + b])[:-1]
    points = np.frombuffer("".join(a + b).encode("utf-32-le", "surrogatepass"), "<u4")
    alphabet, codes = np.unique(points, return_inverse=True)
    out = np.split(codes.astype(np.int64), n)
    return out[: len(a)], out[len(a) :], len(alphabet)


def _masks(texts: list[np.ndarray], size: int) -> np.ndarray:
    """Where each text has each character, as bits: (words of 64 places, texts, characters and one that no text has)."""
    lengths = np.array([len(x) for x in texts], np.int64)
    words = max(1, -(-int(lengths.max(initial=0)) // 64))
    place = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    at = ((place // 64) * len(texts) + np.repeat(np.arange(len(texts)), lengths)) * (size + 1) + np.concatenate([*texts, np.zeros(0, np.int64)])
    out = np.zeros(words * len(texts) * (size + 1), np.uint64)
    np.add.at(out, at, np.uint64(1) << (place % 64).astype(np.uint64))
    return out.reshape(words, len(texts), size + 1)


def _advance(row: np.ndarray, hit: np.ndarray) -> None:
    """One row of ``indel_ratio``'s dynamic program for many pairs, words of 64 places first; ``hit`` is overwritten."""
    carry = None
    for r, h in zip(row, hit, strict=True):
        h &= r
        up = r + h
        if len(row) > 1:
            over = up < h
            if carry is not None:
                up += carry
                over |= up < carry
            carry = over.astype(np.uint64)
        r -= h
        r |= up


def lcs_of_all(a: list[str], b: list[str]) -> np.ndarray:
    """Length of the longest common subsequence of each of ``a`` and each of ``b``."""
    x, y, size = _codes(a, b)
    # The longest first, so that those which have a character at a place stand together.
    order = np.argsort([-len(v) for v in y], kind="stable")
    lengths = np.array([len(y[j]) for j in order], np.int64)
    place = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    columns = np.split(np.concatenate([*(y[j] for j in order), np.zeros(0, np.int64)])[np.argsort(place, kind="stable")], np.cumsum(np.bincount(place)))[:-1]
    out = np.zeros((len(a), len(b)), np.int64)
    by_length = np.argsort([len(v) for v in x], kind="stable")
    for i in range(0, len(a), 16):
        some = by_length[i : i + 16]
        masks = _masks([x[k] for k in some], size)
        row = np.full((len(masks), len(some), len(b)), ~np.uint64(0))
        for c in columns:
            _advance(row[:, :, : len(c)], masks.take(c, axis=2))
        out[some[:, None], order] = np.bitwise_count(~row).sum(axis=0, dtype=np.int64)
    return out


def lcs_of_pairs(a: list[str], b: list[str], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Length of the longest common subsequence of ``a[i]`` and ``b[j]`` for each pair of places; quickest in the order of ``i``."""
    x, y, size = _codes(a, b)
    out = np.zeros(len(i), np.int64)
    width = np.array([len(v).bit_length() for v in y], np.int64)[j]
    for w in np.unique(width):  # a table for strings of similar length, so that a long one doesn't widen it for all
        pairs = np.flatnonzero(width == w)
        used, columns = np.unique(j[pairs], return_inverse=True)
        lengths = np.array([len(y[k]) for k in used], np.int64)
        table = np.full((int(lengths.max()), len(used)), size, np.int32)
        place = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        table[place, np.repeat(np.arange(len(used)), lengths)] = np.concatenate([y[k] for k in used])
        words = max(len(x[k]) for k in np.unique(i[pairs])) // 64 + 1
        step = max(1, min(1 << 16, (1 << 22) // (words * (size + 1))))
        for k in range(0, len(pairs), step):
            some, row_of = np.unique(i[pairs[k : k + step]], return_inverse=True)
            masks = _masks([x[t] for t in some], size)
            flat, at, to = masks.reshape(len(masks), -1), row_of * (size + 1), columns[k : k + step]
            row = np.full((len(masks), len(at)), ~np.uint64(0))
            for c in table:
                _advance(row, flat.take(at + c.take(to), axis=1))
            out[pairs[k : k + step]] = np.bitwise_count(~row).sum(axis=0, dtype=np.int64)
    return out


def cut_places(sample: list[str], edits: int, most: int = 48, longest: int = 16) -> tuple[list[int], float]:
    """Places, from a title's end, that cut it in ``edits`` + 1 pieces, and the share of pairs that a piece brings together.

    The pieces are those that the fewest pairs of ``sample`` share, so that words
    which most titles have fall into one.  What is too short to be cut is more
    than ``edits`` shorter than most titles; without such places the share is 1.
    """
    most = min(most, sorted(map(len, sample))[len(sample) // 20] - edits - 1) if sample else 0
    if most < edits:
        return [], 1.0

    def shared(pieces: list[str]) -> float:
        n = max(len(pieces), 2)
        return 1e-7 + sum(k * (k - 1) for k in Counter(pieces).values()) / (n * (n - 1))

    cost = {(lo, hi): shared([s[len(s) - hi : len(s) - lo] for s in sample if len(s) > hi]) for hi in range(1, most + 1) for lo in range(max(0, hi - longest), hi)}
    held = {0: (0.0, [0])}
    for piece in range(1, edits + 1):
        # A piece meets as many places of the other title as edits before it, and after it, allow.
        weight = min(piece, edits - piece + 2)
        ends: dict[int, tuple[float, list[int]]] = {}
        for (lo, hi), c in cost.items():
            if lo in held:
                ends[hi] = min(ends.get(hi, (9e9, [])), (held[lo][0] + weight * c, [*held[lo][1], hi]))
        held = ends
    share, places = min((c + shared([s[: len(s) - end] for s in sample if len(s) > end]), places) for end, (c, places) in held.items())
    return places, share


def most_alike(a: list[str], b: list[str], least: float, top: int) -> list[tuple[int, str, float]]:
    """(place in ``a``, string of ``b``, ratio): for each of ``a`` the ``top`` best at ``least`` or more, equal ones by string."""
    both = np.array([len(s) for s in a], np.int64)[:, None] + np.array([len(s) for s in b], np.int64)
    scores = np.where(both == 0, 100.0, 200.0 * lcs_of_all(a, b) / np.maximum(both, 1))
    out = []
    for i, row in enumerate(scores):
        good = np.flatnonzero(row >= least)
        if len(good) > top:
            good = good[row[good] >= np.partition(row[good], -top)[-top]]
        out += [(i, t, -score) for score, t in sorted((-float(row[j]), b[j]) for j in good)[:top]]
    return out


@vectorised("double")
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else indel_ratio(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")
