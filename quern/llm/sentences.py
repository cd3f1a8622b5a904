"""Sentence boundaries across languages and scripts, in SQL expressions only.

A cell is cut into blocks (headings, list items, quote lines, paragraphs) and a block into sentences by putting a mark
before each new piece. Before that, full stops that end nothing (decimals, addresses, initials, abbreviations, ordinals)
and end marks inside a sentence that goes on are masked by private-use characters of the same length. Marks are taken
out by the split, masks never change a length, so positions in the masked text are positions in the text: restoring a
sentence is taking its span.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A masked end mark, and the mark between pieces.
MASK, CUT = "\ue010", "\ue002"

# Abbreviations by how a full stop after them is read.
#: A word always follows.
ALWAYS = (
    "Mr Mrs Ms Dr Dra Prof Sr Sra Srta Mme Mlle MM St Hr Fr Frau Herr Ing Gen Col Capt Lt Rev Hon Pres Gov "
    "e.g i.e cf viz vs approx ca bzw vgl sog evtl ggf inkl env véase ej ex aprox p.ej p.ex z.B d.h u.a "
    "ок см напр др проф г-н ул им डॉ श्री प्रो"
)
#: A number follows; before anything else the stop ends the sentence.
NUMBERED = "No Nos Nr Nrn Fig Figs Eq Eqs Abb Tab Bd Kap vol Vol vols pp pág págs núm art Art cap Cap fig Sec sec Ch ch Ref рис табл стр гл илл"
#: Ends the sentence if a capital, a digit or an opening mark follows.
EITHER = "etc usw al Jr Inc Ltd Co Corp a.m p.m U.S"
#: Before a number with a stop: an ordinal.
BEFORE_ORDINAL = "der die das dem den des am im vom zum zur beim seit bis ab jeder jede jedes"
MONTHS = "Januar Februar März April Mai Juni Juli August September Oktober November Dezember"

_SP = r"[\s\u00a0\u202f\u2009]"
_CLOSE = r"[\"”“»’')\]）」』】›*]"
_OPEN = r"[\"“„«‘‹(\[（「『【¿¡]"
#: A lower-case word goes on with the sentence; an identifier such as df_x or v0.8 may begin one.
_LOWER = r"(?=" + _SP + r"+\p{Ll}[\p{L}\p{M}’'\-]*(?![\p{L}\p{M}\p{N}_]))"
_NO = r"(?<![\p{L}\p{M}\p{N}_.\ue010])"


def _any(words: str) -> str:
    return "|".join(
        sorted((w.replace(".", r"[.\ue010]" + _SP + "{0,2}") for w in words.split()), key=len, reverse=True)
    )


_FENCE = r"^[ \t]*\ue002?[ \t]*(?:```|~~~)[\s\S]*?(?:^[ \t]*(?:```|~~~)[ \t]*\ue002?[ \t]*$|\z)"
_IMAGE = r"!\[[^\]\n]*\]\([^)\n]*\)"
_MARKER = r"^\s*(?:>[ \t]?)*[ \t]*(?:#{1,6}[ \t]+|(?:[-*+]|\d+\.)[ \t]+)?"
_UNSEEN = r"[\s\u00a0\u202f\u2009\u200b-\u200f\u2060-\u2064\u00ad\ufeff]"
_ENDS = r"[.!?…؟۔।॥]"
_NEXT = r"(?=\p{Lu}\p{Ll}*(?:['’]\p{L}+)?(?:[\s,\u00a0]|\.\s|\z))"


def _before(words: str) -> str:
    """Behind a stop: that it ends one of ``words``."""
    return r"(?<=" + _NO + r"(?:" + _any(words) + r")\.)"


#: (pattern, replacement), in this order. Every pattern begins with the character it is about, so that most positions
#: are passed over at once.
MASKS = [
    # No mask but a cut: a sentence that begins right behind the last one's end, the space being left out.
    (r"([.!?…][\"”»’)]?)" + _NEXT + r"(?<=[\p{Ll}\p{N}][.!?…][\"”»’)]?)", "$1" + CUT),
    # Decimals, versions, file names, addresses: a stop before a letter or digit; a point that begins a number.
    (r"[.!?](?=[\p{L}\p{N}_/=&%])", MASK),
    (
        r"\.(?:(?=" + _SP + r")(?:"
        # Initials and single-letter abbreviations (J. R., z. B., p. ex., т. е., д.), but т. д. and т. п. may end a
        # sentence.
        + r"(?<=" + _NO + r"\p{L}\.)(?!(?<=т[.\ue010]" + _SP + r"{0,2}[дп]\.)" + _SP + r"+[^\p{Ll}])"
        + r"|(?<=\p{Lu}\ue010\p{Lu}\.)(?=" + _SP + r"+\p{Lu}\p{Ll})"
        # Abbreviations and ordinals.
        + r"|" + _before(ALWAYS) + r"|" + _before(EITHER) + _LOWER
        + r"|(?<=^[ \t]{0,9}\d{1,3}\.)"
        + r"|(?<=(?i:" + _NO + r"(?:" + _any(BEFORE_ORDINAL) + r"))" + _SP + r"{1,2}\d{1,3}\.)(?=" + _SP + r"+\p{L})"
        + r"|(?<=" + _NO + r"\d{1,2}\.)(?=" + _SP + r"+(?:" + _any(MONTHS) + r"))"
        + r")|(?=" + _SP + r"*\d)" + _before(NUMBERED) + r")",
        MASK,
    ),
]
#: For blocks with letters of scripts without case.
MASKS_CASELESS = [
    (r"([.!?؟।])(?=\p{Lo}[\p{Lo}\p{M}])(?<=[\p{Lo}\p{M}]{2}[.!?؟।])", "$1" + CUT),
    # Quoted speech that begins a sentence: what follows carries it on.
    (r"(^" + _SP + r"*|[。！？।؟!?.…]" + _CLOSE + r"?" + _SP + r"*)([“«「『\"])([^“”«»「」『』\"]*)[?!？！؟](?=[”»」』\"]" + _SP + r"*\p{Lo})", "$1$2$3" + MASK),
    (r"[。．！？](?=[”」』]" + _SP + r"*(?:[他她它我你们]{1,2}|有人|大家)[^。！？，]{0,6}[说道问喊答写叫])", MASK),
    # A closing bracket followed by a particle.
    (r"[。！？](?=[」』][とはがをにのもやで、])", MASK),
    # An ellipsis between words of scripts written without spaces.
    (r"…(?=…*[\u3040-\u30ff\u3400-\u9fff])", MASK),
]
#: End marks after which a comma, a dash or a small letter goes on with the sentence, also from behind quotes.
MASK_ON = (
    _ENDS + r"(?=" + _ENDS + r"*(?:" + _SP + r"?" + _CLOSE + r")*(?:" + _SP + r"*[,;:،؛、，；：—–]|" + _LOWER + r"))", MASK
)
#: Where a mark is put: after end marks and closing marks before a space, after full-width ones, and at spaces between
#: Thai words.
CUTS = [(r"(" + _ENDS + r"++" + _CLOSE + r"*+(?:" + _SP + r"?»)?+" + _CLOSE + r"*+)(?=" + _SP + r"+\S)", "$1" + CUT)]
CUTS_CASELESS = [
    (r"([。！？．]++[”’」』）)】》]*+)(?=" + _SP + r"*[^\s。！？])", "$1" + CUT),
    (r"([ \u00a0]+)(?=[\u0e00-\u0e7f])(?<=[\u0e00-\u0e7f][ \u00a0]{1,9})", CUT + "$1"),
]


_RUN = 64


def _starts(lengths: Column) -> Column:
    """The sum of the lengths before each one. Sums are built up by runs, so a cell of many thousand pieces doesn't cost
    their square."""
    add = lambda a, x: a + x
    total = lambda first, n: F.aggregate(F.slice(lengths, first, n), F.lit(0), add)
    runs = F.transform(
        F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / _RUN).cast("int")),
        lambda r: total(r * _RUN + 1, F.lit(_RUN))
    )
    before = F.aggregate(
        runs, F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<int>)").alias("out")), lambda a,
        x: F.struct((a["at"] + x).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")), lambda a: a["out"]
    )
    within = lambda run: F.transform(
        lengths, lambda _, i: F.get(run, (i / _RUN).cast("int")) + total((i - i % _RUN) + 1, i % _RUN)
    )
    return F.element_at(F.transform(F.array(before), within), 1)


def _pieces(marked: Column) -> Column:
    """The pieces between marks as (start, text), with their position in the text without marks."""

    def placed(parts: Column) -> Column:
        return F.arrays_zip(
            F.element_at(F.transform(F.array(F.transform(parts, F.length)), _starts), 1).alias("start"),
            parts.alias("text")
        )

    return F.element_at(F.transform(F.array(F.split(marked, CUT, -1)), placed), 1)


def blocks(cell: Column) -> Column:
    """The blocks of a markdown cell as (start, text), markers included; code, tables and images are blocks of their
    own."""
    clean = F.translate(cell, MASK + CUT, "\ufffd" * 2)
    apart = F.regexp_replace(clean, rf"(?m)({_FENCE}|{_IMAGE})", f"{CUT}$1{CUT}")
    line = r"[^\n]*\n"
    ends = "|".join(
        [
            _FENCE, r"\n(?=[ \t]*\n)", r"\n(?=[ \t]*(?:#{1,6}[ \t]|>|\||[-*+][ \t]|```|~~~))",
            r"\n(?=[ \t]*(?:={3,}|-{3,})[ \t]*(?:\n|\z))", r"^[ \t]*(?:={3,}|-{3,})[ \t]*\n",
            rf"^[ \t]*(?:#{{1,6}}[ \t]|>|\|){line}", rf"^[ \t]*(?:[-*+]|\d+\.)[ \t]{line}(?=[ \t]*\d+\.[ \t])"
        ]
    )
    return _pieces(F.regexp_replace(apart, rf"(?m)({ends})", f"$1{CUT}"))


def _replaced(block: Column, rules: list[tuple[str, str]]) -> Column:
    for pattern, to in rules:
        block = F.regexp_replace(block, pattern, to)
    return block


def cut(block: Column) -> Column:
    """The sentences of a block as (start, text) of the masked text, white space around them included."""
    masked = _replaced(block, MASKS)
    # Bound by a lambda, the masked text is made once and both branches read it.
    caseless = lambda x: _replaced(_replaced(x, MASKS_CASELESS), [MASK_ON, *CUTS, *CUTS_CASELESS])
    cased = lambda x: _replaced(x, [MASK_ON, *CUTS])
    return _pieces(
        F.element_at(
            F.transform(F.array(masked), lambda x: F.when(x.rlike(r"\p{Lo}"), caseless(x)).otherwise(cased(x))), 1
        )
    )


def sentences(docs: DataFrame, key: str = "doc_id", text: str = "text", cells: str = "cells") -> DataFrame:
    """(doc_id, sent_start, sent_end): the sentences of the markdown cells, as offsets in the text (code points, end
    exclusive).

    A sentence reaches from its first to its last visible character. Null or empty texts, null cells and cells without a
    span give nothing; a cell that reaches beyond the text ends with it. Pieces without a letter or digit are no
    sentences. Repeated documents give repeated rows. A block is one paragraph, item or line, so memory is bounded by
    the longest of these and no row shuffles.
    """
    d = docs.select(
        F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("_t"),
        F.explode(F.filter(F.col(cells), lambda c: c["cell_type"] == "markdown")).alias("_c")
    )
    start = F.greatest(F.col("_c.char_start"), F.lit(0))
    d = d.select(
        "doc_id", start.alias("_at"),
        F.expr(
            "substring(_t, greatest(_c.char_start, 0) + 1, greatest(_c.char_end - greatest(_c.char_start, 0), 0))"
        ).alias("_cell")
    ).where("_cell rlike '\\\\S'")
    b = d.select("doc_id", "_at", F.explode(blocks(F.col("_cell"))).alias("_b")).select(
        "doc_id", (F.col("_at") + F.col("_b.start")).alias("_at"), F.col("_b.text").alias("_b")
    )
    b = b.where(~F.col("_b").rlike(r"^\s*(?:```|~~~|\||!\[)") & F.col("_b").rlike(r"[\p{L}\p{N}]"))
    lead = F.length(F.regexp_extract("_b", _MARKER, 0))
    b = b.withColumn("_lead", lead).select(
        "doc_id", (F.col("_at") + F.col("_lead")).alias("_at"), F.expr("substring(_b, _lead + 1)").alias("_b")
    )
    s = b.select(
        "doc_id", "_at", F.explode(cut(F.col("_b"))).alias("_s")
    ).where(F.col("_s.text").rlike(r"[\p{L}\p{N}]"))
    before = F.length(F.regexp_extract("_s.text", rf"^{_UNSEEN}*", 0))
    after = F.length(F.regexp_extract("_s.text", rf"{_UNSEEN}*\z", 0))
    return s.select(
        "doc_id", (F.col("_at") + F.col("_s.start") + before).cast("int").alias("sent_start"),
        (F.col("_at") + F.col("_s.start") + F.length("_s.text") - after).cast("int").alias("sent_end"),
    )


def sentence_texts(docs: DataFrame, key: str = "doc_id", text: str = "text", cells: str = "cells") -> DataFrame:
    """``sentences`` with the sentence itself as ``sentence``: joined back by key, which must be unique here."""
    spans = sentences(docs, key, text, cells)
    return spans.join(docs.select(F.col(key).alias("doc_id"), F.col(text).alias("_t")), "doc_id").select(
        "doc_id", "sent_start", "sent_end",
        F.expr("substring(_t, sent_start + 1, sent_end - sent_start)").alias("sentence")
    )
