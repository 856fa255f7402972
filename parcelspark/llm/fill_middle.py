"""Fill-in-the-middle transformation of whole texts.

A text is cut into units, runs of ASCII letters or single other code points. Two
drawn cuts between units give prefix, middle and suffix, which are written in one
of two orders with markers, or the text stays plain. One numpy kernel treats all
rows of an Arrow batch together, on their UTF-8 bytes: a lookup gives the class of
each byte, a comparison with the byte before marks where units begin, cumulative
sums that restart at each document count them, and one search in those sums finds
the cuts of all rows. Draws are the first four 8-digit groups of the SHA-256 of a
salt and the identifier, so a repeated task agrees with itself.

`restore` gives the text back from output and form. It is exact, since a text that
holds a marker stays plain and no marker can arise where a piece meets a marker.

Defined cases: null and empty texts are plain, without units; a null identifier
draws like an empty one; repeated rows are treated alike; an empty table gives an
empty result. Other input columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelspark.llm import textkit as K
from parcelspark.scratch import prepare

SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Shares in hundredths: of texts left plain, and of the others those with the suffix first.
PLAIN, SUFFIX_FIRST = 10, 20
#: Bytes that the kernel treats at once, or one longer row.
BLOCK = 4 << 20

#: 0 inside a code point, 1 ASCII letter, 2 any other first byte
CLASS = np.full(256, 2, np.uint8)
CLASS[128:192] = 0
CLASS[[*range(65, 91), *range(97, 123)]] = 1
_INNER = np.zeros(256, bool)
_INNER[[ord(m[1]) for m in (PREFIX, SUFFIX, MIDDLE)]] = True


def _sums(mask: np.ndarray) -> np.ndarray:
    out = np.zeros(len(mask) + 1, np.int32 if len(mask) < 1 << 31 else np.int64)
    np.cumsum(mask, dtype=out.dtype, out=out[1:])
    return out


def cuts(buf: np.ndarray, off: np.ndarray, draws: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Units of each row, the bytes where its two drawn cuts lie (rows, 2), and code points of prefix and middle."""
    kind = CLASS[buf]
    begins = kind == 2
    letter = kind == 1
    begins[1:] |= letter[1:] & ~letter[:-1]
    first = off[:-1][off[:-1] < off[1:]]
    begins[first] = True
    units = _sums(begins)
    base = units[off[:-1]].astype(np.int64)
    n = units[off[1:]] - base
    drawn = np.sort(draws % (n + 1)[:, None], axis=1)
    # the byte where unit number `drawn` of the row begins; beyond the last one the row's end
    at = np.searchsorted(units[1:], base[:, None] + drawn + 1)
    at = np.minimum(at, off[1:, None])
    chars = _sums(kind != 0)
    before = chars[at].astype(np.int64)
    return n, at, before[:, 0] - chars[off[:-1]], before[:, 1] - before[:, 0]


def marked(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Whether each row holds one of the markers."""
    out = np.zeros(len(off) - 1, bool)
    if len(buf) > 2:
        at = np.flatnonzero((buf[:-2] == ord("<")) & _INNER[buf[1:-1]] & (buf[2:] == ord(">")))
        row = np.searchsorted(off, at, "right") - 1
        out[row[at + 3 <= off[row + 1]]] = True
    return out


def transform(buf: np.ndarray, off: np.ndarray, draws: np.ndarray, plain: int = PLAIN, suffix_first: int = SUFFIX_FIRST) -> list[pa.Array]:
    """n, form, prefix_chars, middle_chars and output of all rows; draws: (rows, 4)."""
    n, at, prefix, middle = cuts(buf, off, draws[:, :2])
    stays = (off[:-1] == off[1:]) | marked(buf, off) | (draws[:, 2] % 100 >= 100 - plain)
    spm = ~stays & (draws[:, 3] % 100 < suffix_first)
    p, s, m, view, parts = PREFIX.encode(), SUFFIX.encode(), MIDDLE.encode(), memoryview(buf), []
    for a, x, y, b, keep, back in zip(off[:-1].tolist(), at[:, 0].tolist(), at[:, 1].tolist(), off[1:].tolist(), stays.tolist(), spm.tolist(), strict=True):
        if keep:
            parts.append(view[a:b])
        elif back:
            parts += (s, view[y:b], p, view[a:x], m, view[x:y])
        else:
            parts += (p, view[a:x], s, view[y:b], m, view[x:y])
    sizes = off[1:] - off[:-1] + np.where(stays, 0, len(p) + len(s) + len(m))
    ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    output = pa.Array.from_buffers(pa.string(), len(n), [None, pa.py_buffer(ends), pa.py_buffer(b"".join(parts))])
    form = np.where(stays, "plain", np.where(spm, "spm", "psm"))
    return [pa.array(n), pa.array(form.tolist(), pa.string()), pa.array(prefix, mask=stays), pa.array(middle, mask=stays), output]


def draws(key: Column, salt: str) -> list[Column]:
    """Four numbers below 2**32 from the SHA-256 of salt and key."""
    digest = F.sha2(F.concat(F.lit(salt), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salt: str = "1:", plain: int = PLAIN, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """One row per document with its transformed text (see SCHEMA); prefix and middle are null where the text is plain."""
    prepare(docs.sparkSession)
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            buf, off = K.flat(b.column(1))
            h = np.stack([np.asarray(b.column(i)) for i in range(2, 6)], 1) if b.num_rows else np.zeros((0, 4), np.int64)
            for i, j in K.groups(off, BLOCK):
                cols = transform(buf[off[i] : off[j]], off[i : j + 1] - off[i], h[i:j], plain, suffix_first)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), *cols], names)

    key = F.col(id_col).cast("long")
    return docs.select(key.alias("doc_id"), F.col(text_col).alias("text"), *draws(key, salt)).mapInArrow(run, SCHEMA)


def restore(output: Column, form: Column) -> Column:
    """The text from which an output of the given form was made."""
    middle = F.substring_index(output, MIDDLE, -1)
    rest = F.substring_index(output, MIDDLE, 1)

    def unmarked(first: str, second: str) -> tuple[Column, Column]:
        head = F.substring_index(rest, second, 1)
        return F.substr(head, F.lit(len(first) + 1)), F.substring_index(rest, second, -1)

    p, s = unmarked(PREFIX, SUFFIX)
    s2, p2 = unmarked(SUFFIX, PREFIX)
    return F.when(form == "psm", F.concat(p, middle, s)).when(form == "spm", F.concat(p2, middle, s2)).otherwise(output)


def digests(rows: DataFrame) -> DataFrame:
    """rows with the texts as digests: that of the output and that of what `restore` makes of it."""
    kept = [c for c in rows.columns if c != "output"]
    return rows.select(*kept, F.sha2(F.col("output"), 256).alias("output_sha256"), F.sha2(restore(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


SQL = r"""
WITH h AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS d FROM documents),
u AS (
  SELECT doc_id, text, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') AS t,
    CAST('0x' || substr(d, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(d, 9, 8) AS BIGINT) AS h2,
    CAST('0x' || substr(d, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(d, 25, 8) AS BIGINT) AS h4
  FROM h),
c AS (SELECT *, len(t) AS n, least(h1 % (len(t) + 1), h2 % (len(t) + 1)) AS a, greatest(h1 % (len(t) + 1), h2 % (len(t) + 1)) AS b FROM u),
p AS (
  SELECT *, array_to_string(t[1:a], '') AS p, array_to_string(t[a + 1:b], '') AS m, array_to_string(t[b + 1:n], '') AS s,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain'
      WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
  CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM p
"""
