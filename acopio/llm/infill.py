"""Fill-in-the-middle transformation (list item 12).

A Split pre-tokenizer of the tokenizers library cuts a text at each match of a
pattern (isolated, nothing is trained); its offsets are in code points.  Their
number is n, and two draws from the document's id pick the ranks of the offsets
where the middle begins and ends.  The three slices are put together again
around sentinels, prefix first (psm) or suffix first (spm).
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Regex
from tokenizers.pre_tokenizers import Split

from .common import table

PATTERN = "[A-Za-z]+|[^A-Za-z]"
ALONE = " "  # is a unit by itself, so a text may be cut before it and its pieces split one by one
PIECE = 256  # code points; the library takes less time for short strings
SENTINELS = ("<P>", "<S>", "<M>")
FORMS = ("plain", "psm", "spm")


def pieces(text: str, alone: str | None) -> Iterator[tuple[int, str]]:
    """Begin and text of pieces that split as the whole does."""
    at = 0
    while at < len(text):
        end = text.find(alone, at + PIECE) if alone else -1
        end = len(text) if end < 0 else end
        yield at, text[at:end]
        at = end


class Units:
    """The units of a text: how many there are, and where each begins."""

    def __init__(self, split: Split, text: str, alone: str | None):
        self.size, self.begins, self.offsets, self.ends = len(text), [], [], []
        n = 0
        for at, piece in pieces(text, alone):
            offsets = split.pre_tokenize_str(piece)
            n += len(offsets)
            self.begins.append(at)
            self.offsets.append(offsets)
            self.ends.append(n)
        self.n = n

    def begin(self, k: int) -> int:
        """Code points before the k-th unit; all of them for k = n."""
        if k == self.n:
            return self.size
        p = bisect_right(self.ends, k)
        return self.begins[p] + self.offsets[p][k - (self.ends[p - 1] if p else 0)][1][0]


def draws(id_: Column, seed: int) -> list[Column]:
    """Four numbers of 32 bits from the hash of the seed and the decimal id."""
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(hashed, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text that an output of this form was made of."""
    p, s, m = sentinels
    cut = lambda text, mark: F.substring_index(text, mark, 1)
    after = lambda text, head, mark: F.substr(text, F.length(head) + F.lit(len(mark) + 1))
    body = F.substr(output, F.lit(len(p) + 1))
    prefix = cut(body, s)
    rest = after(body, prefix, s)
    suffix = cut(rest, m)
    psm = F.concat(prefix, after(rest, suffix, m), suffix)
    body = F.substr(output, F.lit(len(s) + 1))
    suffix = cut(body, p)
    rest = after(body, suffix, p)
    prefix = cut(rest, m)
    spm = F.concat(prefix, after(rest, prefix, m), suffix)
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def infill(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", pattern: str = PATTERN, alone: str | None = ALONE, sentinels: tuple[str, str, str] = SENTINELS,
    seed: int = 1, plain_percent: int = 10, spm_percent: int = 20,
) -> DataFrame:
    """Transform each text for infilling, all but plain_percent of them, spm_percent of those suffix first.

    Returns the columns of docs with text_col transformed, and n (units of the
    text), form (plain, psm or spm), prefix_chars and middle_chars (code points;
    null if plain), which replace columns of these names.

    alone is a character that pattern always matches by itself, or None to split
    texts whole.

    A text that holds a sentinel stays plain, so that every output can be read
    back (restored()).  Sentinels must be different, not empty, and none may
    begin inside another, else ValueError.

    Nulls: a null text is an empty one and stays plain with n = 0; a null id
    draws as the empty id.  Rows with the same id draw alike, so rows that repeat
    give equal rows.  Ties (both draws at one place) give an empty middle.  A long
    text is held whole, with its offsets, by one task.  An empty table gives an
    empty table.  Other columns pass through, whatever their names.
    """
    if not all(sentinels) or len(set(sentinels)) < 3 or any(x[k:].startswith(y[: len(x) - k]) for x in sentinels for y in sentinels for k in range(len(x)) if k or x != y):
        raise ValueError("sentinels must be different and none may begin inside another")
    others = [c for c in docs.columns if c not in (text_col, "n", "form", "prefix_chars", "middle_chars")]
    text = F.coalesce(F.col(text_col), F.lit(""))
    left = docs.select(text.alias("text"), F.struct(*draws(F.col(id_col), seed)).alias("draw"), F.struct(F.lit(0).alias("_" + "".join(others)), *(F.col(c) for c in others)).alias("row"))
    fields = [T.StructField("text", T.StringType()), T.StructField("n", T.LongType()), T.StructField("form", T.StringType()), T.StructField("prefix_chars", T.LongType()), T.StructField("middle_chars", T.LongType()), left.schema["row"]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = Split(Regex(pattern), "isolated")
        p, s, m = sentinels
        for batch in batches:
            out = []
            for x, draw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                h = list(draw.values())
                units = Units(split, x, alone)
                n = units.n
                if not x or any(mark in x for mark in sentinels) or h[2] % 100 >= 100 - plain_percent:
                    out.append((x, n, FORMS[0], None, None))
                    continue
                a, b = (units.begin(k) for k in sorted((h[0] % (n + 1), h[1] % (n + 1))))
                if h[3] % 100 < spm_percent:
                    out.append((f"{s}{x[b:]}{p}{x[:a]}{m}{x[a:b]}", n, FORMS[2], a, b - a))
                else:
                    out.append((f"{p}{x[:a]}{s}{x[b:]}{m}{x[a:b]}", n, FORMS[1], a, b - a))
            columns = list(zip(*out, strict=True)) or [()] * 5
            kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip(columns, kinds, strict=True)), batch.column(2)], names=[f.name for f in fields])

    done = left.mapInArrow(run, T.StructType(fields))
    return done.select(*(F.col(f"row.`{c}`").alias(c) for c in others), F.col("text").alias(text_col), "n", "form", "prefix_chars", "middle_chars")


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = infill(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("text", 256).alias("output_sha256"), F.sha2(restored(F.col("text"), F.col("form")), 256).alias("restored_sha256"))


OP12_SQL = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || doc_id) AS x FROM documents
), h AS (
  SELECT doc_id, t, u, len(u) AS n, ('0x' || substr(x, 1, 8))::BIGINT AS h1, ('0x' || substr(x, 9, 8))::BIGINT AS h2, ('0x' || substr(x, 17, 8))::BIGINT AS h3, ('0x' || substr(x, 25, 8))::BIGINT AS h4 FROM d
), c AS (
  SELECT *, length(array_to_string(u[:least(h1 % (n + 1), h2 % (n + 1))], '')) AS a, length(array_to_string(u[:greatest(h1 % (n + 1), h2 % (n + 1))], '')) AS b,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM h
)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN a END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END::BIGINT AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || substr(t, 1, a) || '<S>' || substr(t, b + 1) || '<M>' || substr(t, a + 1, b - a)
              ELSE '<S>' || substr(t, b + 1) || '<P>' || substr(t, 1, a) || '<M>' || substr(t, a + 1, b - a) END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM c
"""
