"""Text decoded with the wrong character encoding: find it and restore it.

Every distinct clean word of the corpus that has characters outside ASCII is
garbled under all encoding chains.  The tokens of the records are hash-joined
with this table; a token that equals the garbled form of a clean word is damage,
and the word is its original.  Words whose clean form never occurs are
caught by the same table over word *shapes* (ASCII runs folded) for punctuation and
by inverting the chain where that is unambiguous.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docketlens.session import spill

FIELDS = ("comment_text", "attachment_text")
#: A clean word must be so many times as frequent as a garbled form that an honest word could equal.
WORD_RATIO, SHAPE_RATIO = 3, 20
_TOKEN = re.compile("[A-Za-z0-9\u0080-\U0010ffff]*[\u0080-\U0010ffff][A-Za-z0-9\u0080-\U0010ffff]*")
_ASCII = re.compile("[A-Za-z0-9]+")
LOST = "�"

# Encodings of stored text, and encodings it is read with by mistake.
WRITTEN = ("cp1252", "mac_roman", "cp850", "iso8859_15")
READ = ("cp1252", "latin-1", "mac_roman", "cp850", "cp437", "iso8859_15", "cp1250", "cp1251", "cp1254", "koi8_r", "iso8859_2")
READ_WIDE = ("gbk", "big5", "shift_jis", "euc_kr")
#: Characters of the languages and signs at home in the corpus; a clean word has no other.
_HOME = frozenset(
    [chr(c) for c in range(0xA0, 0x180) if c != 0xAC]
    + list(" ­‐‑‒–—―‘’‚“”„†‡•…‰′″‹›€™⁰⁴⁵⁶⁷⁸⁹−≠≤≥∞Ω")
    + [chr(c) for c in range(0x391, 0x3CA)]
)


def _table(encoding: str) -> list[str]:
    """The 256 characters of a one-byte encoding; bytes it leaves open stand for themselves, as browsers read them."""
    out = []
    for i in range(256):
        try:
            out.append(bytes([i]).decode(encoding))
        except UnicodeDecodeError:
            out.append(chr(i))
    return out


_DECODE = {e: _table(e) for e in READ}
_ENCODE = {e: {c: i for i, c in reversed(list(enumerate(t)))} for e, t in _DECODE.items()}


def _as_read(raw: bytes, encoding: str) -> str | None:
    if encoding in _DECODE:
        table = _DECODE[encoding]
        return "".join(table[b] for b in raw)
    return raw.decode(encoding, "replace")


def garbled_forms(word: str) -> Iterator[tuple[str, str]]:
    """(chain, form) of every way the word can have been misread; forms equal to the word are left out."""
    utf8 = word.encode("utf-8", "ignore")
    for read in READ + READ_WIDE:
        form = _as_read(utf8, read)
        yield f"utf-8>{read}", form
        if read in ("cp1252", "latin-1", "mac_roman"):
            twice = form.encode("utf-8", "ignore")
            for again in ("cp1252", "latin-1"):
                yield f"utf-8>{read}>utf-8>{again}", _as_read(twice, again)
    for written in WRITTEN:
        try:
            raw = word.encode(written)
        except UnicodeEncodeError:
            continue
        for read in READ:
            if read != written:
                yield f"{written}>{read}", _as_read(raw, read)
        yield f"{written}>utf-8", raw.decode("utf-8", "replace")
    yield "utf-8>ascii", utf8.decode("ascii", "replace")


def inverted(token: str) -> tuple[str, str] | None:
    """(chain, original) if reading the token's bytes as UTF-8 under some encoding gives characters at home in the corpus."""
    for read in READ + READ_WIDE:
        try:
            raw = bytes(_ENCODE[read][c] for c in token) if read in _ENCODE else token.encode(read)
            text = raw.decode("utf-8")
        except (KeyError, UnicodeError):
            continue
        if text == token or len(text) >= len(token) or not all(c < "\x80" or c in _HOME for c in text) or all(c < "\x80" for c in text):
            continue
        return f"utf-8>{read}", inverted(text)[1] if inverted(text) else text
    return None


def is_clean(token: str) -> bool:
    return all(c < "\x80" or c in _HOME for c in token) and inverted(token) is None


def _shape(token: str) -> str:
    return _ASCII.sub("a", token)


def _mixed(token: str) -> bool:
    """Characters of a foreign script or drawing set right beside Latin letters: no language writes so."""
    return any(c.isascii() and c.isalpha() for c in token) and any("\u0400" <= c <= "\u04ff" or "\u2500" <= c <= "\u259f" or "\u3040" <= c <= "\u9fff" or "\uac00" <= c <= "\ud7ff" for c in token)


def _letters_at_home(token: str) -> bool:
    return all(c < "\x80" or c in _HOME and c.isalpha() for c in token)


def _punctuation_only(token: str) -> bool:
    return not any(c >= "\x80" and c.isalpha() for c in token)


_TOK = pa.schema([("field", pa.string()), ("comment_id", pa.string()), ("token", pa.string())])


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("comment_id").to_pylist()
        out: tuple[list, ...] = ([], [], [])
        for field in FIELDS:
            for comment_id, text in zip(ids, batch.column(field).to_pylist()):
                if text and not text.isascii():
                    for token in set(_TOKEN.findall(text)):
                        out[0].append(field)
                        out[1].append(comment_id)
                        out[2].append(token)
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in out], schema=_TOK)


_FORM = pa.schema([("form", pa.string()), ("shape", pa.bool_()), ("original", pa.string()), ("chain", pa.string()), ("n", pa.int64())])
_FORM_SQL = "form string, shape boolean, original string, chain string, n long"


def _garble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: tuple[list, ...] = ([], [], [], [], [])
        for word, n in zip(batch.column("token").to_pylist(), batch.column("n").to_pylist()):
            if not is_clean(word):
                continue
            kinds = [(word, False)] + ([(_shape(word), True)] if _punctuation_only(word) else [])
            for source, shape in kinds:
                for chain, form in garbled_forms(source):
                    if form and form != source and not form.isascii():
                        for column, value in zip(out, (form, shape, source, chain, n)):
                            column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, _FORM.types)], schema=_FORM)


_OWN = pa.schema([("token", pa.string()), ("n", pa.int64()), ("shape", pa.string()), ("plain", pa.bool_()), ("certain", pa.bool_()), ("own", pa.string()), ("own_chain", pa.string())])
_OWN_SQL = "token string, n long, shape string, plain boolean, certain boolean, own string, own_chain string"


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: tuple[list, ...] = ([], [], [], [], [], [], [])
        for token, n in zip(batch.column("token").to_pylist(), batch.column("n").to_pylist()):
            back = inverted(token)
            # Replacement characters and C1 controls never belong to rightly decoded text.
            certain = LOST in token or any("\x80" <= c < "\xa0" for c in token) or back is not None or _mixed(token)
            for column, value in zip(out, (token, n, _shape(token), _letters_at_home(token), certain, back and back[1], back and back[0])):
                column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, _OWN.types)], schema=_OWN)


def damaged_tokens(comments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(tokens of every record, (token, original, chain) of the damaged ones; original NULL where it can't be told)."""
    tokens = spill(comments.select("comment_id", *FIELDS).where("comment_id is not null").mapInArrow(_tokens, "field string, comment_id string, token string"), "p3-tokens")
    vocabulary = spill(tokens.groupBy("token").agg(F.count("*").alias("n")), "p3-words")
    forms = vocabulary.mapInArrow(_garble, _FORM_SQL)
    forms = forms.groupBy("form", "shape", "original").agg(F.min("chain").alias("chain"), F.sum("n").alias("n"))
    best = F.row_number().over(Window.partitionBy("form", "shape").orderBy(F.desc("n"), "original"))
    forms = spill(forms.withColumn("best", best).where("best = 1").drop("best"), "p3-forms")
    own = vocabulary.mapInArrow(_judge, _OWN_SQL)
    by_word = forms.where("not shape").select(F.col("form").alias("token"), F.col("original").alias("w_original"), F.col("chain").alias("w_chain"), F.col("n").alias("w_n"))
    by_shape = forms.where("shape").select(F.col("form").alias("shape"), F.col("original").alias("s_original"), F.col("chain").alias("s_chain"), F.col("n").alias("s_n"))
    shapes = own.groupBy("shape").agg(F.sum("n").alias("shape_n"))
    joined = own.join(by_word, "token", "left").join(by_shape.join(shapes, "shape"), "shape", "left")
    word = F.col("w_original").isNotNull() & (F.col("certain") | (F.col("w_n") >= F.col("n") * WORD_RATIO))
    # A word all of whose letters are at home (capitals of a rare word) is not judged by its shape.
    shape = F.col("s_original").isNotNull() & (F.col("certain") | (~F.col("plain") & (F.col("s_n") >= F.col("shape_n") * SHAPE_RATIO)))
    damaged = joined.where(F.col("certain") | word | shape)
    found = damaged.select(
        "token",
        F.when(word, F.col("w_original")).when(F.col("own").isNotNull(), F.col("own")).alias("original"),
        F.when(~word & F.col("own").isNull() & shape, F.col("s_original")).alias("shape"),
        F.when(word, F.col("w_chain")).when(F.col("own").isNotNull(), F.col("own_chain")).when(shape, F.col("s_chain")).alias("chain"),
    )
    return tokens, found


def damaged_records(comments: DataFrame) -> DataFrame:
    """p3: distinct (field, comment_id) whose field holds wrongly decoded text.  NULL, empty and ASCII texts never do."""
    tokens, found = damaged_tokens(comments)
    return tokens.join(found.select("token"), "token", "left_semi").select("field", "comment_id").distinct()


def _restorer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, repaired, lost = [], [], []
        for text, pairs in zip(batch.column("text").to_pylist(), batch.column("pairs").to_pylist()):
            known = {p["token"]: p for p in pairs}
            done = missed = 0

            def put(match: re.Match) -> str:
                nonlocal done, missed
                whole = match.group()
                pair = known.get(whole)
                if pair is None:
                    return whole
                new = pair["original"]
                if new is None and pair["shape"] is not None:
                    runs = _ASCII.findall(whole)
                    new = re.sub("a", lambda _: runs.pop(0) if runs else "", pair["shape"]) if pair["shape"].count("a") == len(runs) else None
                if new is None:
                    missed += 1
                    return whole
                done += 1
                return new

            texts.append(_TOKEN.sub(put, text))
            repaired.append(done)
            lost.append(missed)
        keep = [batch.column(c) for c in ("field", "comment_id")]
        yield pa.RecordBatch.from_arrays([*keep, pa.array(texts, pa.string()), pa.array(repaired, pa.int32()), pa.array(lost, pa.int32())], names=["field", "comment_id", "restored", "repaired", "lost"])


def restored_records(comments: DataFrame) -> DataFrame:
    """p3: the damaged records with their text restored as far as possible, the number of words repaired and of words that stay damaged."""
    tokens, found = damaged_tokens(comments)
    per_record = tokens.join(found, "token").groupBy("field", "comment_id").agg(F.collect_set(F.struct("token", "original", "shape")).alias("pairs"))
    long_form = None
    for field in FIELDS:
        part = comments.select(F.lit(field).alias("field"), "comment_id", F.col(field).alias("text")).where("text is not null")
        long_form = part if long_form is None else long_form.unionByName(part)
    texts = long_form.join(per_record, ["field", "comment_id"])
    return texts.mapInArrow(_restorer, "field string, comment_id string, restored string, repaired int, lost int").distinct()
