"""Fill-in-the-middle forms of texts by escaped markers, in column functions only.

Two characters are reserved while a text is cut: ``MARK`` ends a unit and ``ESCAPE`` introduces an escaped one. Both are escaped in
the text first, so that after ``regexp_replace`` has appended ``MARK`` to every unit, marks count the units and ``substring_index``
takes ranked runs of them, whatever the text holds.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MARK, ESCAPE = "\x01", "\x02"
LINES = r"[^\n]*\n|[^\n]+"


@dataclass(frozen=True)
class Form:
    """How texts are rearranged. Units are what ``unit`` (a regular expression that covers every text) matches from left to right."""

    unit: str = LINES
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"
    seed: int = 7
    share: int = 100  # texts of a hundred that are rearranged
    spm: int = 50  # of a hundred of these, those with the suffix first

    def __post_init__(self) -> None:
        for m in self.markers:
            if not m or any(m.startswith(m[k:]) for k in range(1, len(m))):
                raise ValueError(f"the marker {m!r} could be found across the end of a part")

    @property
    def markers(self) -> list[str]:
        return [self.prefix, self.suffix, self.middle]


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE + "2")), F.lit(MARK), F.lit(ESCAPE + "1"))


def unescaped(marked: Column) -> Column:
    """The text of a run of marked units."""
    plain = F.replace(marked, F.lit(MARK), F.lit(""))
    return F.replace(F.replace(plain, F.lit(ESCAPE + "1"), F.lit(MARK)), F.lit(ESCAPE + "2"), F.lit(ESCAPE))


def draws(key: Column, seed: int, count: int = 4) -> list[Column]:
    """Unsigned 32-bit numbers from the checksum of ``seed:key``; a null key counts as empty text."""
    text = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(text, 8 * k + 1, 8), 16, 10).cast("long").alias(f"__h{k + 1}") for k in range(count)]


def rearranged(docs: DataFrame, form: Form = Form(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with ``n`` (units), ``form`` (plain, psm or spm), ``prefix``, ``middle``, ``suffix`` (null if plain) and ``output``.

    The prefix ends after ``min`` and the middle after ``max`` of two draws from 0 to n units. A text stays plain if it is empty, holds
    one of the three markers, or its draw is beyond ``share``. A null text counts as empty. Columns of ``docs`` with a name of the
    result are replaced. Every row is handled by itself: no shuffle, no Python.
    """
    own = ["n", "form", "prefix", "middle", "suffix", "output"]
    kept = [c for c in docs.columns if c not in own]
    rows = docs.select(*kept, F.coalesce(text, F.lit("")).alias("__t"), *draws(F.col(key), form.seed))
    rows = rows.select("*", F.regexp_replace(escaped(F.col("__t")), f"({form.unit})", "$1" + MARK).alias("__m"))
    rows = rows.select("*", (F.length("__m") - F.length(F.replace(F.col("__m"), F.lit(MARK), F.lit("")))).cast("long").alias("n"))
    one, two = F.pmod(F.col("__h1"), F.col("n") + 1), F.pmod(F.col("__h2"), F.col("n") + 1)
    held = F.lit(False)
    for marker in form.markers:
        held = held | F.contains(F.col("__t"), F.lit(marker))
    plain = (F.col("__t") == "") | held | (F.col("__h3") % 100 >= form.share)
    kind = F.when(plain, "plain").when(F.col("__h4") % 100 < form.spm, "spm").otherwise("psm")
    rows = rows.select(*kept, "__t", "__m", "n", kind.alias("form"), F.least(one, two).cast("int").alias("__a"), F.greatest(one, two).cast("int").alias("__b"))
    part = lambda start, count: F.call_function("substring_index", start, F.lit(MARK), count)
    moved = F.col("form") != "plain"
    head = part(F.col("__m"), F.col("__b"))
    rows = rows.select(*kept, "__t", "n", "form", F.when(moved, unescaped(part(F.col("__m"), F.col("__a")))).alias("prefix"),
                       F.when(moved, unescaped(part(head, F.col("__a") - F.col("__b")))).alias("middle"),
                       F.when(moved, unescaped(part(F.col("__m"), F.col("__b") - F.col("n").cast("int") - 1))).alias("suffix"))
    p, s, m = (F.lit(x) for x in form.markers)
    psm, spm = F.concat(p, "prefix", s, "suffix", m, "middle"), F.concat(s, "suffix", p, "prefix", m, "middle")
    output = F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm).otherwise(F.col("__t"))
    return rows.select(*kept, "n", "form", "prefix", "middle", "suffix", output.alias("output"))


def restored(rows: DataFrame, form: Form = Form(), output: str = "output", name: str = "restored") -> DataFrame:
    """``rows`` with the text that ``output`` and ``form`` stand for; markers cannot be in the parts, so each is found once."""
    before = lambda text, marker: F.substring_index(text, marker, 1)
    after = lambda text, marker: F.substring(text, F.length(before(text, marker)) + len(marker) + 1, F.length(text))
    psm = F.col("form") == "psm"
    first, second = (F.when(psm, F.lit(a)).otherwise(F.lit(b)) for a, b in ((form.prefix, form.suffix), (form.suffix, form.prefix)))
    moved = rows.select("*", F.when(F.col("form") != "plain", F.substring(F.col(output), F.length(first) + 1, F.length(output))).alias("__body"), second.alias("__second"))
    head = F.call_function("substring_index", F.col("__body"), F.col("__second"), F.lit(1))
    moved = moved.select("*", head.alias("__one"))
    moved = moved.select("*", F.substring(F.col("__body"), F.length("__one") + F.length("__second") + 1, F.length("__body")).alias("__rest"))
    moved = moved.select("*", before(F.col("__rest"), form.middle).alias("__two"), after(F.col("__rest"), form.middle).alias("__mid"))
    text = F.when(F.col("form") == "plain", F.col(output)).when(psm, F.concat("__one", "__mid", "__two")).otherwise(F.concat("__two", "__mid", "__one"))
    return moved.select(*rows.columns, text.alias(name))


def digests(docs: DataFrame, form: Form = Form()) -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256`` of every document."""
    rows = restored(rearranged(docs.select("doc_id", "text"), form), form)
    sha = lambda c: F.sha2(F.col(c).cast("binary"), 256)
    return rows.select("doc_id", "n", "form", F.length("prefix").cast("long").alias("prefix_chars"), F.length("middle").cast("long").alias("middle_chars"),
                       sha("output").alias("output_sha256"), sha("restored").alias("restored_sha256"))
