"""Fill-in-middle transformation by escaped marker injection. DataFrame functions only.

A text is cut into units at places drawn from its id. The cut is made without arrays of units: a delimiter byte is
escaped out of the text, ``regexp_replace`` puts one after every unit, the delimiters are counted, and
``substring_index`` takes the units up to, between and after two ranks. The parts are unescaped and put together with
markers. A text of any length stays one string, of which a task holds a few copies; nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A unit is a word with the white space before it, or white space at the end.
UNIT = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED, RATE, SPM_SHARE = 42, 50, 80
#: The delimiter and the escape. Neither is white space, so escaping changes no unit's borders.
_END, _ESCAPE = "\x01", "\x02"


def escaped(text: Column) -> Column:
    """The text without _END: the escape is written _ESCAPE e, the delimiter _ESCAPE d."""
    return F.replace(F.replace(text, F.lit(_ESCAPE), F.lit(_ESCAPE + "e")), F.lit(_END), F.lit(_ESCAPE + "d"))


def unescaped(text: Column) -> Column:
    """What :func:`escaped` was given."""
    return F.replace(F.replace(text, F.lit(_ESCAPE + "d"), F.lit(_END)), F.lit(_ESCAPE + "e"), F.lit(_ESCAPE))


def _ranked(marked: str, count: str) -> Column:
    return F.expr(f"substring_index({marked}, '\\u{ord(_END):04x}', cast({count} as int))")


def _draw(doc_id: Column, group: int, seed: int) -> Column:
    """The group-th 8 hexadecimal digits of the SHA-256 of ``seed:doc_id``, as a number."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(digest, 8 * group + 1, 8), 16, 10).cast("long")


def fill_in_middle(docs: DataFrame, rate: int = RATE, spm_share: int = SPM_SHARE, seed: int = SEED) -> DataFrame:
    """``doc_id, n, form, prefix, middle, suffix, output`` for each row of ``docs`` (doc_id, text).

    n is the number of units. ``rate`` of 100 texts are transformed, of these ``spm_share`` of 100 with the suffix first (spm), the
    others with the prefix first (psm). A null text is empty. Texts that are empty or hold a marker stay as they are
    (plain: the output is the text, the parts are null). Draws depend on the id alone: rows repeated under one id are cut
    at the same ranks of their own units, and a null id draws as an empty one. Parts may be empty. Empty tables give no
    rows; columns besides doc_id and text are not read.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    own = own.withColumn("marked", F.regexp_replace(escaped(F.col("text")), UNIT, "$0" + _END))
    own = own.withColumn("n", (F.length("marked") - F.length(F.replace(F.col("marked"), F.lit(_END), F.lit("")))).cast("long"))
    h = [_draw(F.col("doc_id"), i, seed) for i in range(4)]
    own = own.withColumns({"x": h[0] % (F.col("n") + 1), "y": h[1] % (F.col("n") + 1)}).withColumns({"a": F.least("x", "y"), "b": F.greatest("x", "y")})
    marker = F.lit(False)
    for m in (PREFIX, SUFFIX, MIDDLE):
        marker = marker | F.contains("text", F.lit(m))
    plain = (F.col("n") == 0) | marker | (h[2] % 100 >= rate)
    own = own.withColumn("form", F.when(plain, "plain").when(h[3] % 100 < spm_share, "spm").otherwise("psm"))
    # every unit has a delimiter after it: the last k units are right of the k + 1st delimiter from the end
    own = own.withColumn("head", _ranked("marked", "b"))
    cut = F.col("form") != "plain"
    parts = {"prefix": _ranked("marked", "a"), "middle": _ranked("head", "a - b"), "suffix": _ranked("marked", "b - n - 1")}
    own = own.withColumns({k: F.when(cut, unescaped(F.replace(v, F.lit(_END), F.lit("")))) for k, v in parts.items()})
    psm = F.concat(F.lit(PREFIX), "prefix", F.lit(SUFFIX), "suffix", F.lit(MIDDLE), "middle")
    spm = F.concat(F.lit(SUFFIX), "suffix", F.lit(PREFIX), "prefix", F.lit(MIDDLE), "middle")
    output = F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm).otherwise(F.col("text"))
    return own.select("doc_id", "n", "form", "prefix", "middle", "suffix", output.alias("output"))


def restored(output: Column, form: Column) -> Column:
    """The text that an output of :func:`fill_in_middle` was made of, from the output and its form alone.

    A transformed text holds no marker itself and markers do not overlap, so each occurs once in the output.
    """
    middle = F.substring_index(output, MIDDLE, -1)
    front = F.substring_index(output, MIDDLE, 1)
    after_prefix, after_suffix = F.substring_index(front, PREFIX, -1), F.substring_index(front, SUFFIX, -1)
    psm = F.concat(F.substring_index(after_prefix, SUFFIX, 1), middle, after_suffix)
    spm = F.concat(after_prefix, middle, F.substring_index(after_suffix, PREFIX, 1))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def digests(docs: DataFrame) -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256`` for each row of docs, with the default parameters."""
    out = fill_in_middle(docs)
    back = restored(F.col("output"), F.col("form"))
    return out.select("doc_id", "n", "form", F.length("prefix").cast("long").alias("prefix_chars"), F.length("middle").cast("long").alias("middle_chars"), F.sha2(F.col("output"), 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))
