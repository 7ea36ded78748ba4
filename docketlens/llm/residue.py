"""Template residue, dummy copy, error pages and script notices in documents.

Texts are cut into messages (lines, sentences and unfilled slots).  Numbers,
addresses and dates are masked, dummy words and repetitions folded, and the exact
hash of the masked form is grouped over all documents and sources.  What recurs is
classified once per hash by phrase and placeholder rules, and trusted if it mostly
stands in documents that hold little else; a document that holds a trusted message
holds residue.  What occurs once is compared with phrases and slot styles learned
from the recurring messages, and must make up most of its document.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketlens.llm import textops as tx
from docketlens.session import spill

#: Share of a document's words (titles left out) that residue makes up where it stands alone, and that messages seen once must make up.
SHARE_ALONE, SHARE_SINGLE = 0.3, 0.6
#: Share of a recurring message's documents in which residue must stand alone.
TRUST = 0.5
#: Parts a message that stands in very many documents is spread over.
SALTS = 16

_CUT = re.compile(r"\n+|(?<=[.!?])\s+")
_ADDRESS = re.compile(r"\S+@\S+|https?://\S+|(?<!\w)/[\w./-]+|#?\b(?=[0-9a-f]*\d)[0-9a-f]{6,}\b")
_TO_MASK = re.compile(r"[0-9@/]")
_NUMBER = re.compile(r"\d+(?:[.,:/-]\d+)*")

# What a slot may name.
_FIELDS = frozenset(
    "name names first last full middle your my insert date day month year city state zip code address street county district phone email e mail contact "
    "organization organisation company agency office docket id number no n title of rule the senator representative congressman member issue topic subject "
    "story personal here signature recipient sender user customer client a and or".split()
)
_SLOT_HINT = re.compile(r"[\[{<«@%_]|\*\||\(Y|XXXX")
_SLOT_SIGN = re.compile(r"[\[{<«@%_*(X]")
_SLOT_STRONG = re.compile(
    r"\{\{[^{}\n]{1,60}\}\}|\{%[^%\n]{1,60}%\}|<%=?[^%\n]{1,60}%>|\$\{[^{}\n]{1,60}\}|#\{[^{}\n]{1,60}\}|<<[^<>\n]{1,60}>>|\*\|[^|\n]{1,60}\|\*|@@[^@\n]{1,60}@@"
    r"|(?<![\w%])%[A-Z][A-Z_]*%(?![\w%])|(?<!\w)__[A-Z][A-Z_., ]*__(?!\w)|\[(?:insert|INSERT|Insert)\s[^\[\]\n]{1,60}\]|\(YOUR [^()\n]{1,60} HERE\)|(?<!\w)X{4,}(?:-X+)*(?!\w)"
)
_SLOT_NAMED = re.compile(r"\[([^\[\]\n]{1,60})\]|(?<!<)<([^<>\n]{1,60})>(?!>)|(?<![{$#])\{([^{}\n]{1,60})\}(?!\})|«([^«»\n]{1,60})»")
_BLANK = re.compile(r"_{5,}")
_NAME_WORD = re.compile(r"[A-Za-z]+")

# Words of the customary dummy Latin.
_LATIN = frozenset(
    "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis "
    "nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla "
    "pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum".split()
)
_FILLER = re.compile(
    r"\b(?:dummy|filler|sample|placeholder|dummytext)\s+(?:text|copy|paragraph|content|page|heading)\b|\b(?:text|copy|content|body|paragraph|description|story)\s+(?:goes here|to come|to follow|coming soon)\b"
    r"|\b(?:your|insert|enter|add|type)\s+(?:your\s+)?(?:text|content|copy)\s+here\b|\breplace this (?:paragraph|text|sentence|copy)\b|\badd (?:a |your |summary |second |another |first |third )+(?:paragraph|text)\b"
    r"|\blorem ipsum\b|\bwill be replaced before (?:launch|publication)\b|\bfor layout only\b"
)
_ERROR = re.compile(
    r"\bhttp[ /]?0\b|\b(?:error|fehler|erreur|status|errno|code)[ :#=]{0,2}0\b|\berror code\b|\bnot found\b|\b(?:page|document|resource|file|docket)\b.{0,40}\b(?:not (?:be )?(?:found|available|retrieved|loaded|displayed)|no longer (?:exists|available))"
    r"|\bcould(?: not|n.t) (?:find|be (?:found|retrieved|loaded))\b|\bbad gateway\b|\bservice unavailable\b|\btemporarily unavailable\b|\bgateway time-?out\b|\binternal server error\b|\bdid not respond\b"
    r"|\btoo many requests\b|\b(?:hourly|daily|rate) limit\b|\bretry after\b|\bsession (?:has )?(?:expired|timed out)\b|\bsign in again\b|\b(?:try|please try) again later\b|\bsomething went wrong\b|\baccess denied\b|\bforbidden\b"
    r"|\b(?:do not|don.t) have permission\b|\bunhandled exception\b|\btraceback\b|\bstack trace\b|\b(?:timeout|null\w*|io|runtime|key|type|value)(?:error|exception|reference)\b|\bconnection (?:failed|refused|reset|timed out)\b"
    r"|\blink may be broken\b|\bmay have moved\b|\bverify (?:that )?you are (?:a )?human\b|\bchecking your (?:connection|browser)\b|\bcaptcha\b|\bunusual traffic\b|\bbeen blocked\b"
    r"|\bnicht gefunden\b|\bno se ha encontrado\b|\bintrouvable\b|\bno disponible\b|\bnicht verfügbar\b|\bindisponible\b|\bzugriff verweigert\b|\bacceso denegado\b|\baccès refusé\b|\"error\"\s*:|^(?:ray|trace|reference) #?"
)
_SCRIPT = re.compile(
    r"\b(?:java)?script(?:s|ing)?\b|\bnoscript\b|\bcookies?\b|\bbrowser does(?: not|n.t) support\b"
)
_SCRIPT_DEED = re.compile(r"\b(?:enable|enabled|allow|allowed|activate|activated|turn(?:ed)? o[nf]f?|blocks?|blocked|requires?|disabled|necessary|need|activez|activer|aktivieren|aktiviert|active|active[nz]|habilit\w+|permit\w*|accept|noscript|support)\b")
_CHROME = re.compile(r"^(?:menu|share|loading|skip to|back to|home\b|©|print\b|sign in|help\b|heading 0)|\|\s*docket viewer$")
_TRIGGER = frozenset(
    "http error fehler erreur status errno gateway unavailable denied forbidden exception traceback trace timeouterror verify checking captcha blocked "
    "gefunden encontrado introuvable disponible verfügbar indisponible verweigert denegado refusé retrieved ray reference expired wrong respond "
    "javascript script scripts scripting noscript cookie cookies dummy filler placeholder lorem layout".split()
)
# Words of everyday prose count only in these turns.
_TURNS = (
    *(f"not {be}{deed}" for be in ("", "be ") for deed in ("found", "available", "retrieved", "loaded", "displayed")), "no longer ", "couldn", "too many requests", " limit;", "retry after", "sign in again", "try again", "may be broken", "have moved", "permission", "connection failed", "connection refused",
    "unusual traffic", "browser does", "sample text", "sample copy", " goes here", "text here", "content here", "copy here", *(f"{noun} to {deed}" for noun in ("text", "copy", "content", "body", "paragraph", "description", "story") for deed in ("come", "follow")), "coming soon", "replace this", "paragraph", "will be replaced",
)

PLACEHOLDER, FILLER, ERROR, SCRIPT, CHROME = "placeholder", "filler", "error_page", "script_notice", "chrome"
#: A whole sentence of dummy Latin: filler wherever it stands.
LATIN, LATIN_WORDS = "latin", 5

# Names of months in the four languages.
_MONTHS = (
    "january february march april may june july august september october november december enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre "
    "janvier février mars avril mai juin juillet août septembre octobre novembre décembre januar februar märz april mai juni juli oktober dezember jan feb mar apr jun jul aug sep sept oct nov dec".split()
)
_MONTH = "(?:" + "|".join(sorted(set(_MONTHS), key=lambda m: (-len(m), m))) + r")\b\.?"
_DATE = re.compile(rf"\b0(?:st|nd|rd|th|er|\.)?\s+(?:de\s+|of\s+)?{_MONTH}(?:,?\s+(?:del?\s+)?0\b)?|\b{_MONTH}\s+0(?:st|nd|rd|th)?\b(?:,?\s+0\b)?")


def mask(message: str) -> str:
    """Lower case; numbers, addresses and dates masked, white space folded."""
    low = message.lower()
    if not _TO_MASK.search(low):
        return " ".join(low.split())
    return _DATE.sub("0", " ".join(_NUMBER.sub("0", _ADDRESS.sub("<h>", low)).split()))


def slots(message: str) -> list[tuple[str, bool]]:
    """(masked form, whether its form alone tells) of every slot in a message."""
    out = []
    if "__" in message and (blank := _BLANK.search(message)) and _NAME_WORD.search(message[: blank.start()] + message[blank.end() :]):
        out.append(("_____", True))
    if not _SLOT_SIGN.search(message) or not _SLOT_HINT.search(message):
        return out
    fold = lambda slot: re.sub(r"x{4,}", "xxxx", re.sub(r"\d+", "0", re.sub(r"[_\s]+", " ", slot.lower())))
    for found in _SLOT_STRONG.finditer(message):
        out.append((fold(found.group()), True))
    for found in _SLOT_NAMED.finditer(_SLOT_STRONG.sub(" ", message)):
        names = _NAME_WORD.findall(next(g for g in found.groups() if g is not None).replace("_", " "))
        if names and all(n.lower() in _FIELDS for n in names):
            out.append((fold(found.group()), False))
    return out


def style(slot: str) -> str:
    """What a slot is written between: its first and last sign."""
    return slot[0] + slot[-1]


def folded(masked: str, words: list[str]) -> str:
    """Sentences of dummy Latin and of one or two words over and over all read the same."""
    distinct = set(words)
    if len(words) >= 3 and len(distinct) == 1 or len(words) >= 6 and len(distinct) <= 2 and not words[0].isdigit():
        return "<again>"
    if len(words) >= 3 and len(latin := distinct & _LATIN) >= 0.6 * len(distinct):
        return "<latin>" if len(latin) >= LATIN_WORDS else "<some latin>"
    return masked


def classify(masked: str) -> str | None:
    """Kind of a masked message by phrase rules, None for other text."""
    if masked in ("<again>", "<some latin>"):
        return FILLER
    if masked == "<latin>":
        return LATIN
    if _FILLER.search(masked):
        return FILLER
    if _SCRIPT.search(masked) and _SCRIPT_DEED.search(masked):
        return SCRIPT
    return ERROR if _ERROR.search(masked) else None


def _screen() -> ahocorasick.Automaton:
    """Finds the words and turns without which no phrase rule applies."""
    out = ahocorasick.Automaton()
    for phrase in (*_TRIGGER, *_TURNS, *(w + end for w in _LATIN if len(w) > 4 for end in " .,;:!?")):
        out.add_word(phrase, 1)
    out.make_automaton()
    return out


def _repeats(words: list[str]) -> bool:
    return any(a == c and (a == b or b == d) for a, b, c, d in zip(words, words[1:], words[2:], [*words[3:], None]))


_UNIT = pa.schema([("doc_id", pa.int64()), ("source", pa.string()), ("h", pa.int64()), ("masked", pa.string()), ("sign", pa.string()), ("words", pa.int32())])
_UNIT_SQL = "doc_id long, source string, h long, masked string, sign string, words int"


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per document one row with its words (h NULL), and one per message that some rule may apply to; ``sign`` is set for slots: s where the form alone tells, w elsewhere."""
    screen = _screen()
    for batch in batches:
        out: tuple[list, ...] = tuple([] for _ in _UNIT)

        def add(*row) -> None:
            for column, value in zip(out, row):
                column.append(value)

        for doc_id, source, text in zip(batch.column("doc_id").to_pylist(), batch.column("source").to_pylist(), batch.column("text").to_pylist()):
            if not text:
                continue
            low = " ".join(text.lower().split())
            words = tx.WORD.findall(low)
            again = _repeats(words)
            phrases = again or next(screen.iter(low + " "), None) is not None
            signs = _SLOT_SIGN.search(text) is not None
            titles = 0
            for message in _CUT.split(text) if phrases or signs else (line for line in text.split("\n") if len(line) < 60):
                if not message.strip():
                    continue
                if signs:
                    for form, tells in slots(message):
                        add(doc_id, source, xxhash.xxh3_64_intdigest("slot " + form) - (1 << 63), form, "s" if tells else "w", 0)
                short = len(message) < 60 and message.rstrip()[-1] not in ".!?"
                hit = phrases and next(screen.iter(" ".join(message.lower().split()) + " "), None) is not None
                if not short and not hit and not (again and _repeats(tx.WORD.findall(message.lower()))):
                    continue
                masked = mask(message)
                told = tx.WORD.findall(masked)
                if len(told) <= 8 and _CHROME.search(masked):
                    titles += len(told)
                    continue
                form = folded(masked, told)
                if hit or form != masked:
                    add(doc_id, source, xxhash.xxh3_64_intdigest(form) - (1 << 63), form, None, len(told) or 1)
                    if len(told) > 5 or not short or classify(form):
                        continue
                if short and len(told) <= 5:
                    titles += len(told)  # titles and labels neither make nor break a page
            add(doc_id, None, None, None, None, max(0, len(words) - titles))
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, _UNIT.types)], schema=_UNIT)


_KIND = pa.schema([("h", pa.int64()), ("kind", pa.string()), ("style", pa.string()), ("recurs", pa.bool_()), ("runs", pa.list_(pa.int64()))])
_KIND_SQL = "h long, kind string, style string, recurs boolean, runs array<long>"


def _classify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Kind of each distinct message; ``runs`` are hashes of its runs of three words."""
    for batch in batches:
        kinds, styles, runs = [], [], []
        for masked, sign in zip(batch.column("masked").to_pylist(), batch.column("sign").to_pylist()):
            words = tx.WORD.findall(masked) if sign is None else []
            kinds.append(PLACEHOLDER if sign else classify(masked))
            styles.append(style(masked) if sign == "w" else None)
            runs.append([xxhash.xxh3_64_intdigest(" ".join(words[k : k + 3])) - (1 << 63) for k in range(len(words) - 2)])
        yield pa.RecordBatch.from_arrays([batch.column("h"), pa.array(kinds, pa.string()), pa.array(styles, pa.string()), batch.column("recurs"), pa.array(runs, pa.list_(pa.int64()))], schema=_KIND)


def message_kinds(units: DataFrame) -> DataFrame:
    """(h, kind, recurs, learned) of every distinct message that a rule or a learned phrase applies to.

    A message recurs if it stands in several documents of several sources.  A slot
    seen once whose form alone doesn't tell needs a style that a recurring slot has.
    """
    # Sides of a join that grow with the input are never broadcast: the planner knows them by their compressed size only.
    # One row per message and source first, so that a message in a third of all documents meets the shuffle as a few rows.
    by_source = units.where("h is not null").groupBy("h", "source").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.min("masked").alias("masked"), F.min("sign").alias("sign"))
    grouped = by_source.groupBy("h").agg(F.min("masked").alias("masked"), F.min("sign").alias("sign"), ((F.max("high") > F.min("low")) & (F.count("*") > 1)).alias("recurs"))
    told = spill(grouped.mapInArrow(_classify, _KIND_SQL), "p10-kinds")
    runs = told.where("recurs and style is null").select(F.explode("runs").alias("run"), "kind")
    learned = runs.groupBy("run").agg(F.min("kind").alias("taught"), F.max(F.col("kind").isNull()).alias("prose")).where("not prose and taught is not null").select("run", "taught")
    once = told.where("not recurs and style is null").select("h", F.explode("runs").alias("run")).join(learned.hint("merge"), "run").groupBy("h").agg(F.min("taught").alias("taught"))
    styles = told.where("recurs").select("style").where("style is not null").distinct().withColumn("usual", F.lit(True))
    both = told.join(once.hint("merge"), "h", "left").join(styles, "style", "left")
    kind = F.coalesce("kind", "taught")
    return spill(both.where(kind.isNotNull() & (F.col("recurs") | F.col("style").isNull() | F.col("usual"))).select("h", kind.alias("kind"), "recurs", F.col("taught").isNotNull().alias("learned")), "p10-told")


def judged_kinds(documents: DataFrame) -> DataFrame:
    """(doc_id, kind, route): the kinds of residue of each document; route ``recurring`` where a recurring message decides, else ``single``."""
    units = spill(documents.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "source", "text").mapInArrow(_units, _UNIT_SQL), "p10-units")
    told = message_kinds(units)
    salt = F.pmod("doc_id", F.lit(SALTS)).cast("int").alias("salt")
    # Never broadcast: the copies are more than the planner's estimate.
    spread = lambda df: df.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).hint("merge")
    held = units.where("h is not null").groupBy("doc_id", "h").agg(F.sum("words").alias("words")).select("*", salt)
    marked = spill(held.join(spread(told), ["h", "salt"]).select("doc_id", "h", "kind", "recurs", "learned", "words"), "p10-marked")
    telling = marked.where(F.col("kind") != PLACEHOLDER)
    size = units.where("h is null").groupBy("doc_id").agg(F.sum("words").alias("all"))
    shares = telling.groupBy("doc_id").agg(F.sum("words").alias("residue")).join(size.hint("merge"), "doc_id").select("doc_id", "all", (F.col("residue") >= F.col("all") * SHARE_ALONE).alias("alone"))
    shares = spill(shares, "p10-shares").hint("merge")
    stands = telling.where("recurs").join(shares, "doc_id").groupBy("h").agg(F.avg(F.col("alone").cast("int")).alias("alone"))
    trusted = spread(stands.where(F.col("alone") >= TRUST).select("h"))
    sure = telling.where("recurs").select("*", salt).join(trusted, ["h", "salt"]).select("doc_id", "kind")
    sure = sure.unionAll(marked.where((F.col("kind").isin(LATIN, PLACEHOLDER)) & F.col("recurs")).select("doc_id", "kind"))
    # Messages seen once, and recurring ones beside them, by their share of the document.
    weight = F.col("words") * F.when(F.col("learned"), SHARE_SINGLE / SHARE_ALONE).otherwise(1.0)
    single = telling.groupBy("doc_id", "kind").agg(F.sum(weight).alias("weight"), F.min("recurs").alias("recurs")).where("not recurs").join(shares, "doc_id").where(F.col("weight") >= F.col("all") * SHARE_SINGLE)
    single = single.select("doc_id", "kind").unionAll(marked.where(F.col("kind").isin(LATIN, PLACEHOLDER) & ~F.col("recurs")).select("doc_id", "kind"))
    both = sure.withColumn("route", F.lit("recurring")).unionAll(single.withColumn("route", F.lit("single")))
    kind = F.when(F.col("kind") == LATIN, FILLER).otherwise(F.col("kind"))
    return both.withColumn("kind", kind).groupBy("doc_id", "kind").agg(F.min("route").alias("route"))


def residue_kinds(documents: DataFrame) -> DataFrame:
    """p10: distinct (doc_id, kind) of documents that hold residue.

    NULL and empty texts have none; a doc_id that repeats is judged by all its rows
    together.  Slots and sentences of dummy Latin count wherever they stand (a slot
    seen once if its form or a learned style tells), other recurring messages if they
    are trusted (see the module's text).  Other messages seen once must make up
    SHARE_SINGLE of the document's words, those with a learned phrase SHARE_ALONE.
    """
    return judged_kinds(documents).select("doc_id", "kind")


def without_residue(documents: DataFrame) -> DataFrame:
    """p10: the documents that hold no residue, all columns unchanged."""
    return documents.join(residue_kinds(documents).select("doc_id").distinct().hint("merge"), "doc_id", "left_anti")
