"""Noise in text from scanned pages: find it and rebuild continuous paragraphs.

Lines are labelled body, header or break (printed page number) by a hidden
Markov model over layout features.  Its parameters are estimated by EM on a
bounded sample of texts (SAMPLE texts, the lowest hashes of comment_id and text).  Words
split across lines and misread words are settled by counts over all texts:
a split is noise if the joined word is commoner than the hyphenated one, and a
word is misread if undoing customary misreadings gives a far commoner word.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketlens.session import spill

SAMPLE, EM_ROUNDS = 2000, 6
BODY, HEADER, BREAK = 0, 1, 2
MIN_LINES, MAX_WIDTH = 4, 90
#: How much commoner the corrected word must be: with a digit or sign inside the word, and by letters only.
SIGN_RATIO, LETTER_RATIO, MIN_COUNT = 4, 40, 4
MAX_UNDONE, LONG_WORD = 3, 24
#: A word in more than this share of all texts is no remainder of a split one.
PART_SHARE = 0.005
#: Bits of the sieve of misread tokens: 2 MB at any size of input.
SIEVE_BITS = 1 << 24

# What print becomes when misread, as (read, printed).
MISREAD_SIGNS = (("0", "o"), ("1", "l"), ("1", "i"), ("5", "s"), ("@", "a"), ("9", "g"), ("6", "b"), ("8", "b"))
MISREAD_LETTERS = (("c", "e"), ("f", "t"), ("l", "i"), ("cl", "d"), ("ii", "u"), ("rn", "m"), ("li", "h"), ("vv", "w"), ("n", "ri"), ("h", "li"), ("m", "in"), ("m", "rn"), ("l", "t"), ("d", "cl"))

_LINE = re.compile("[\n\x0c]")
_NUMBERED = re.compile(r"^\W{0,2}\s*(?:(page|p\.|pg\.?|seite|página|pagina)\s*)?(\d{1,4})\s*(?:(?:of|de|von|sur|/)\s*(\d{1,4}))?\s*\W{0,2}$", re.IGNORECASE)
_EMBEDDED = re.compile(r"^\s*(\d{1,4})\s*\|\s*\S|\S\s{2,}(?:page|p\.|seite|página)\s*(\d{1,4})\s*$|\S\s*\|\s*(?:(?:page|p\.)\s*)?(\d{1,4})\s*$", re.IGNORECASE)
_SPLIT = re.compile("([^\\W\\d_][\\w@'’]*)([-\xad‐‑])\\s*$")
_START = re.compile(r"\s*([^\W\d_][\w@'’]*)")
_TOKEN = re.compile(r"[\w@]*[^\W_@][\w@]*(?:-[\w@]+)*")
_FOLD = (("cl", "d"), ("rn", "m"), ("vv", "w"), ("ii", "u"), ("li", "h"))
_FOLD_CHARS = str.maketrans("015@96il3c8f", "olsagblleeb" + "t")


def _hash(word: str) -> int:
    return xxhash.xxh3_64_intdigest(word) - (1 << 63)


_PAGE_PART = re.compile(r"^\s*\d{1,4}\s*\|\s*|\s{2,}(?:page|p\.|seite|página)?\s*\d{1,4}\s*$|\s*\|\s*(?:page|p\.)?\s*\d{1,4}\s*$", re.IGNORECASE)
_TAIL = re.compile(r"^[^\W\d_A-Z].*[.!?,;:]$")


def fold(line: str) -> str:
    """A line without its page number and with look-alike characters made equal, to compare furniture lines read differently; empty for the end of a sentence."""
    if _TAIL.match(line.strip()):
        return ""
    text = re.sub(r"[|—–-]", " ", _PAGE_PART.sub("", line.lower()))
    for read, printed in _FOLD:
        text = text.replace(read, printed)
    return re.sub(r"[^\w]+", "", text.translate(_FOLD_CHARS))


def lines_of(text: str | None) -> list[tuple[str, bool, bool]]:
    """(line, follows a blank line or form feed, page edge before it) of the non-blank lines."""
    out, gap, feed = [], True, True
    for part in re.split("(\x0c)|\n", text or ""):
        if part is None:
            continue
        if part == "\x0c":
            gap = feed = True
        elif part.strip():
            out.append((part, gap, feed))
            gap = feed = False
        else:
            gap = True
    return out


def is_wrapped(lines: list[tuple[str, bool, bool]]) -> bool:
    """Lines of one moderate width, as a page has; text with a line per paragraph isn't."""
    if len(lines) < MIN_LINES:
        return False
    widths = sorted(len(line) for line, _, _ in lines)
    return widths[int(0.9 * len(widths))] <= MAX_WIDTH and widths[len(widths) // 2] >= 25


#: Number of values of each feature of a line.
FEATURES = (4, 2, 2, 2, 2)


def layout(lines: list[tuple[str, bool, bool]]) -> np.ndarray:
    """Feature values of each line: number form, recurs, short, at a page edge or gap, interrupts a sentence."""
    n = len(lines)
    out = np.zeros((n, len(FEATURES)), np.int8)
    folded = [fold(line) for line, _, _ in lines]
    times: dict[str, int] = {}
    for f in folded:
        if len(f) >= 6:
            times[f] = times.get(f, 0) + 1
    median = sorted(len(line) for line, _, _ in lines)[n // 2] if n else 0
    numbers = [_NUMBERED.match(line) for line, _, _ in lines]
    values = [int(m.group(2)) if m else -1 for m in numbers]
    sequence = [i for i, v in enumerate(values) if v >= 0]
    in_order = {i for k, i in enumerate(sequence) if (k and values[sequence[k - 1]] + 1 == values[i]) or (k + 1 < len(sequence) and values[sequence[k + 1]] == values[i] + 1)}
    for i, (line, gap, feed) in enumerate(lines):
        if numbers[i]:
            named = numbers[i].group(1) or numbers[i].group(3) or line.strip().startswith("-")
            out[i, 0] = 3 if named and (i in in_order or values[i] == 1) else 2 if i in in_order or named else 1
        elif _EMBEDDED.search(line) and times.get(folded[i], 0) > 1:
            out[i, 0] = 1
        out[i, 1] = times.get(folded[i], 0) > 1
        out[i, 2] = len(line) < 0.75 * median
        after = lines[i + 1] if i + 1 < n else None
        out[i, 3] = gap or feed or after is None or after[1] or after[2]
        before = next((lines[j][0] for j in range(i - 1, -1, -1) if values[j] < 0 and times.get(folded[j], 0) < 2), None)
        behind = next((lines[j][0] for j in range(i + 1, n) if values[j] < 0 and times.get(folded[j], 0) < 2), None)
        out[i, 4] = bool(before and behind and before.rstrip()[-1] not in ".!?:…\"”" and behind.lstrip()[0].islower() and not line.lstrip()[:1].islower())
    return out


def _start_model() -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Start probabilities, transitions and emissions before EM: weak beliefs about page furniture."""
    begin = np.array([0.7, 0.2, 0.1])
    step = np.array([[0.9, 0.04, 0.06], [0.8, 0.05, 0.15], [0.5, 0.45, 0.05]])
    emit = [
        np.array([[0.99, 0.008, 0.001, 0.001], [0.8, 0.19, 0.005, 0.005], [1e-9, 0.1, 0.3, 0.6]]),
        np.array([[0.995, 0.005], [1e-9, 1.0], [0.5, 0.5]]),
        np.array([[0.8, 0.2], [0.4, 0.6], [0.02, 0.98]]),
        np.array([[0.7, 0.3], [0.2, 0.8], [0.1, 0.9]]),
        np.array([[0.97, 0.03], [0.5, 0.5], [0.4, 0.6]]),
    ]
    return begin, step, emit


def _likelihood(features: np.ndarray, emit: list[np.ndarray]) -> np.ndarray:
    out = np.ones((len(features), 3))
    for f, table in enumerate(emit):
        out *= table[:, features[:, f]].T
    return out


def train(sample: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """EM over the feature sequences of sampled texts; an empty sample leaves the start values."""
    begin, step, emit = _start_model()
    prior = [4 * table for table in emit]
    for _ in range(EM_ROUNDS if sample else 0):
        n_begin, n_step, n_emit = begin * 4, step * 20, [p.copy() for p in prior]
        for features in sample:
            like = _likelihood(features, emit)
            n = len(like)
            ahead, back = np.empty((n, 3)), np.ones((n, 3))
            ahead[0] = begin * like[0]
            ahead[0] /= ahead[0].sum()
            for t in range(1, n):
                ahead[t] = ahead[t - 1] @ step * like[t]
                ahead[t] /= ahead[t].sum()
            for t in range(n - 2, -1, -1):
                back[t] = step @ (like[t + 1] * back[t + 1])
                back[t] /= back[t].sum()
            share = ahead * back
            share /= share.sum(axis=1, keepdims=True)
            n_begin += share[0]
            if n > 1:
                pair = ahead[:-1, :, None] * step[None] * (like[1:] * back[1:])[:, None, :]
                n_step += (pair / pair.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
            for f, size in enumerate(FEATURES):
                for v in range(size):
                    n_emit[f][:, v] += share[features[:, f] == v].sum(axis=0)
        begin = n_begin / n_begin.sum()
        step = n_step / n_step.sum(axis=1, keepdims=True)
        # What the labels mean stays fixed: a break shows a number, a header recurs.
        n_emit[0][BREAK, 0] = n_emit[1][HEADER, 0] = 1e-9
        emit = [e / e.sum(axis=1, keepdims=True) for e in n_emit]
    return begin, step, emit


def decode(features: np.ndarray, model) -> list[int]:
    """Most likely labels of the lines (Viterbi)."""
    begin, step, emit = model
    like = np.log(_likelihood(features, emit)).tolist()
    step = np.log(step).tolist()
    best = [b + x for b, x in zip(np.log(begin).tolist(), like[0])]
    track = []
    for row in like[1:]:
        choice, fresh = [], []
        for s in range(3):
            scores = [best[p] + step[p][s] for p in range(3)]
            p = scores.index(max(scores))
            choice.append(p)
            fresh.append(scores[p] + row[s])
        track.append(choice)
        best = fresh
    state = best.index(max(best))
    out = [state]
    for choice in reversed(track):
        state = choice[state]
        out.append(state)
    return out[::-1]


def label_lines(lines: list[tuple[str, bool, bool]], model) -> tuple[list[int], np.ndarray]:
    features = layout(lines)
    return decode(features, model), features


def splits(lines: list[tuple[str, bool, bool]], labels: list[int]) -> list[tuple[int, str, str, str]]:
    """(index of the line, left part, mark, right part) of words split across body lines."""
    body = [i for i, label in enumerate(labels) if label == BODY]
    out = []
    for i, j in zip(body, body[1:]):
        left, right = _SPLIT.search(lines[i][0]), _START.match(lines[j][0])
        if left and right and right.group(1)[0].islower():
            out.append((i, left.group(1).lower(), left.group(2), right.group(1).lower()))
    return out


_COUNT = pa.schema([("token", pa.string()), ("n", pa.int64())])


def _count_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts: dict[str, int] = {}
        for text in batch.column("attachment_text").to_pylist():
            if text:
                for token in set(_TOKEN.findall(text.lower())):
                    counts[token] = counts.get(token, 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], schema=_COUNT)


def corrections(token: str) -> Iterator[tuple[str, bool]]:
    """(word, by signs only) for every way to undo up to MAX_UNDONE misreadings in a token."""
    places = [(i, read, printed, True) for read, printed in MISREAD_SIGNS for i in range(len(token)) if token.startswith(read, i)]
    if not any(c.isalpha() for c in token):
        return
    letters = [(i, read, printed, False) for read, printed in MISREAD_LETTERS for i in range(len(token)) if token.startswith(read, i)]
    signs_needed = len({p[0] for p in places})
    # In very long words one misreading at most, so that the work stays in proportion to their length.
    for k in range(1, (MAX_UNDONE if len(token) <= LONG_WORD else 1) + 1):
        for chosen in combinations(places + letters, k):
            by_sign = sum(c[3] for c in chosen)
            # Signs inside a word are all undone; letters on their own at most one at a time, two with signs.
            if len({c[0] for c in chosen if c[3]}) < signs_needed or k - by_sign > (1 if k == 1 or by_sign else 2) or signs_needed > MAX_UNDONE:
                continue
            at = sorted(chosen)
            if any(a[0] + len(a[1]) > b[0] for a, b in zip(at, at[1:])):
                continue
            out, last = [], 0
            for i, read, printed, _ in at:
                out += [token[last:i], printed]
                last = i + len(read)
            word = "".join(out) + token[last:]
            if word.isalpha():
                yield word, by_sign == k


_FIX = pa.schema([("token", pa.string()), ("n", pa.int64()), ("word", pa.string()), ("signs", pa.bool_())])


def _propose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: tuple[list, ...] = ([], [], [], [])
        for token, n in zip(batch.column("token").to_pylist(), batch.column("n").to_pylist()):
            for part in (token,) if "-" not in token else ():
                for word, signs in set(corrections(part)):
                    for column, value in zip(out, (token, n, word, signs)):
                        column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, _FIX.types)], schema=_FIX)


def vocabulary(attachments: DataFrame) -> DataFrame:
    """(token, n): number of texts with each token, over all texts."""
    return spill(attachments.select("attachment_text").mapInArrow(_count_tokens, "token string, n long").groupBy("token").agg(F.sum("n").alias("n")), "p7-words")


def misread_table(words: DataFrame) -> DataFrame:
    """(token, word): tokens that are misread forms of a far commoner word, with the commonest such word."""
    open_tokens = words.where((F.length("token") >= 2) & (F.col("token").rlike("[0-9@]") & F.col("token").rlike("(?U)\\p{L}") | (F.length("token") >= 4)))
    # Only words that can be corrected to something commoner matter: the commonest words never are.
    proposed = open_tokens.mapInArrow(_propose, "token string, n long, word string, signs boolean")
    known = words.where(F.col("n") >= MIN_COUNT).select(F.col("token").alias("word"), F.col("n").alias("word_n"))
    fit = proposed.join(known, "word").where(F.col("word_n") >= F.col("n") * F.when(F.col("signs"), SIGN_RATIO).otherwise(LETTER_RATIO))
    return spill(fit.groupBy("token").agg(F.max_by("word", F.struct("word_n", "word")).alias("word")), "p7-misread")


_NOTE = pa.schema([("comment_id", pa.string()), ("kind", pa.string()), ("a", pa.string()), ("b", pa.string()), ("c", pa.string())])
_NOTE_SQL = "comment_id string, kind string, a string, b string, c string"


_PLACE = pa.schema([("word", pa.int32()), ("bit", pa.int64())])


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        place = np.array([_hash(t) % SIEVE_BITS for t in batch.column("token").to_pylist()], dtype=np.int64)
        yield pa.RecordBatch.from_arrays([pa.array((place >> 5).astype(np.int32)), pa.array(np.int64(1) << (place & 31))], schema=_PLACE)


def misread_sieve(misread: DataFrame) -> np.ndarray:
    """Bit set of all misread tokens; of fixed size, so that it lets more through, but never loses one, as tokens grow."""
    rows = misread.select("token").mapInArrow(_places, "word int, bit long").groupBy("word").agg(F.bit_or("bit").alias("bits")).toPandas()
    out = np.zeros(SIEVE_BITS // 32, np.int64)
    out[rows["word"].to_numpy(dtype=np.int64)] = rows["bits"].to_numpy(dtype=np.int64)
    return out


class Sifted(dict):
    """token -> whether it may be a misread one; a bounded memo in front of the sieve."""

    def __init__(self, bits: np.ndarray):
        super().__init__()
        self.bits = bits

    def __missing__(self, token: str) -> bool:
        if len(self) >= 1_000_000:
            self.clear()
        place = _hash(token) % SIEVE_BITS
        self[token] = value = bool(self.bits[place >> 5] >> (place & 31) & 1)
        return value


def _noter(model, sieve: np.ndarray):
    def notes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sifted = Sifted(sieve)
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [])

            def add(*row) -> None:
                for column, value in zip(out, row):
                    column.append(value)

            for comment_id, text in zip(batch.column("comment_id").to_pylist(), batch.column("attachment_text").to_pylist()):
                lines = lines_of(text)
                if not is_wrapped(lines):
                    continue
                labels, features = label_lines(lines, model)
                if HEADER in labels:
                    add(comment_id, "running_header", None, None, None)
                if BREAK in labels or any(label == HEADER and _EMBEDDED.search(line[0]) for label, line in zip(labels, lines)):
                    add(comment_id, "page_number", None, None, None)
                for _, left, mark, right in splits(lines, labels):
                    add(comment_id, "hyphenation" if mark != "-" else "split", left + right, f"{left}-{right}", right)
                fragments = {x for _, left, _, right in splits(lines, labels) for x in (left, right)}
                seen = set()
                for line, label in zip(lines, labels):
                    seen.update(_TOKEN.findall(line[0].lower()))
                for token in seen - fragments:
                    if sifted[token]:
                        add(comment_id, "token", token, None, None)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in out], schema=_NOTE)

    return notes


_FEAT = pa.schema([("features", pa.binary())])


def _feature_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text in batch.column("attachment_text").to_pylist():
            lines = lines_of(text)
            if is_wrapped(lines):
                out.append(layout(lines).tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], schema=_FEAT)


def layout_model(attachments: DataFrame):
    """The line model, estimated on the feature sequences of at most SAMPLE texts (the lowest hashes of comment_id and text).

    Only hashes are ordered; the texts themselves stay where they are.
    """
    hashed = attachments.withColumn("h", F.xxhash64("comment_id", "attachment_text"))
    last = hashed.select("h").distinct().orderBy("h").limit(SAMPLE).agg(F.max("h")).first()[0]
    if last is None:
        return train([])
    rows = hashed.where(F.col("h") <= last).dropDuplicates(["h"]).select("attachment_text").mapInArrow(_feature_batches, "features binary").collect()
    return train(sorted((np.frombuffer(bytes(r[0]), np.int8).reshape(-1, len(FEATURES)) for r in rows), key=lambda f: f.tobytes()))


def _attachments(comments: DataFrame) -> DataFrame:
    return comments.where("comment_id is not null and attachment_text is not null").select("comment_id", "attachment_text")


def scan_notes(comments: DataFrame) -> tuple[DataFrame, tuple]:
    """(noise notes per comment: kind and, for words, what stands and what belongs there; the line model)."""
    attachments = _attachments(comments)
    model = layout_model(attachments)
    words = vocabulary(attachments)
    misread = misread_table(words)
    # Only tokens that may be misread are noted, so that common words never meet a shuffle.
    notes = spill(attachments.mapInArrow(_noter(model, misread_sieve(misread)), _NOTE_SQL), "p7-notes")
    furniture = notes.where(F.col("kind").isin("running_header", "page_number", "hyphenation")).select("comment_id", "kind", "a", F.col("a").alias("word"))
    # Each different split word is looked up once.
    apart = notes.where("kind = 'split'").select("a", "b", "c").distinct()
    count = lambda name: words.select(F.col("token").alias(name), F.col("n").alias(f"{name}_n"))
    known = apart.join(count("a"), "a", "left").join(count("b"), "b", "left").join(count("c"), "c", "left")
    # The mark is the word's own if the hyphenated word is commoner; where neither is known, a common right part speaks for two words.
    joined, own, part = F.coalesce("a_n", F.lit(0)), F.coalesce("b_n", F.lit(0)), F.coalesce("c_n", F.lit(0))
    noise = (joined > own) | ((joined == 0) & (own == 0) & (part <= PART_SHARE * attachments.count()))
    split = known.where(noise).select("b", F.col("a").alias("word"))
    hyphens = notes.where("kind = 'split'").select("comment_id", "b").join(split, "b").select("comment_id", F.lit("hyphenation").alias("kind"), F.col("b").alias("a"), "word")
    wrong = notes.where("kind = 'token'").select("comment_id", F.col("a").alias("token")).join(misread, "token").select("comment_id", F.lit("misread").alias("kind"), F.col("token").alias("a"), "word")
    return furniture.unionByName(hyphens).unionByName(wrong), model


def noise_kinds(comments: DataFrame) -> DataFrame:
    """p7: distinct (comment_id, kind) of scanned attachments with noise.  NULL, empty and unwrapped texts have none."""
    notes, _ = scan_notes(comments)
    return notes.select("comment_id", "kind").distinct()


def _rebuilder(model):
    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, notes in zip(batch.column("attachment_text").to_pylist(), batch.column("notes").to_pylist()):
                fixes = {n["a"]: n["word"] for n in notes or [] if n["a"]}
                lines = lines_of(text)
                if not is_wrapped(lines):
                    out.append(text)
                    continue
                labels, _ = label_lines(lines, model)
                out.append(paragraphs(lines, labels, fixes))
            yield pa.RecordBatch.from_arrays([batch.column("comment_id"), pa.array(out, pa.string())], names=["comment_id", "repaired_text"])

    return rebuild


def _repaired(match: re.Match, fixes: dict[str, str]) -> str:
    token = match.group()
    word = fixes.get(token.lower())
    if word is None or "-" in token:
        return token
    return word.upper() if token.isupper() and len(token) > 1 else word.capitalize() if token[0].isupper() else word


def paragraphs(lines: list[tuple[str, bool, bool]], labels: list[int], fixes: dict[str, str]) -> str:
    """Body lines as continuous paragraphs: furniture left out, noise hyphens joined, misread words put right."""
    out: list[str] = []
    pending = None
    interrupted = False
    for (line, gap, _), label in zip(lines, labels):
        if label != BODY:
            interrupted = True
            continue
        line = line.strip()
        if pending is None:
            pending, interrupted = line, False
            continue
        left, right = _SPLIT.search(pending), _START.match(line)
        goes_on = not gap or interrupted or bool(left)
        if gap and goes_on and not left:
            goes_on = pending[-1] not in ".!?:" and line[0].islower()
        if not goes_on:
            out.append(pending)
            pending = line
        elif left and right:
            own = left.group(2) == "-" and f"{left.group(1)}-{right.group(1)}".lower() not in fixes
            pending = (pending.rstrip() if own else pending[: left.start(2)]) + line
        else:
            pending += " " + line
        interrupted = False
    if pending is not None:
        out.append(pending)
    return "\n\n".join(_TOKEN.sub(lambda m: _repaired(m, fixes), p) for p in out)


def repaired_texts(comments: DataFrame) -> DataFrame:
    """p7: (comment_id, repaired_text) of the attachments that hold scan noise; repeats of a comment give one row per different text."""
    notes, model = scan_notes(comments)
    per_comment = notes.groupBy("comment_id").agg(F.collect_set(F.struct("a", "word")).alias("notes"))
    attachments = _attachments(comments)
    return attachments.join(per_comment, "comment_id").mapInArrow(_rebuilder(model), "comment_id string, repaired_text string").distinct()
