"""Fill-in-the-middle: texts cut at two units into prefix, middle and suffix, and written in another order.

Units are lines (each with its line feed) or code points.  While a text's units are counted, a sparse index keeps the
byte and code-point offset of every ``EVERY``-th unit; a cut is found by a binary search for the checkpoint before it
and a short rescan from there.  Counting goes through a text in windows of ``WINDOW`` bytes, so what a task holds
besides the text itself is one checkpoint for ``EVERY`` units.

The cuts, the form and whether a text is changed at all come from a hash of seed and id: the result doesn't depend on
partitions, order or retries.  A text that holds a mark stays plain, so an output tells its parts without doubt and
``restored`` gives the text back from output and form.

Null texts are empty; empty texts stay plain.  A null id hashes as the empty string.  Texts of one unit may get empty
parts.  Repeated rows each give a row.  An empty table gives an empty result.  Other columns are kept by
``fill_in_middle`` as they are, unless they have the name of a new one, which is refused.
"""
import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrays import lean, text_slices

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
EVERY = 64
WINDOW = 1 << 20
RESCAN = 1 << 12


def _line_starts(window, before):
    """Where units start in a window of bytes, given the byte before it (a line feed at the start of a text)."""
    starts = np.flatnonzero(window[:-1] == 10) + 1
    return np.concatenate([[0], starts]) if before == 10 else starts


def _char_starts(window, before):
    return np.flatnonzero((window & 0xC0) != 0x80)


UNITS = {"line": _line_starts, "char": _char_starts}


class Checkpoints:
    """The number of units of a text, and byte and code-point offsets of every ``every``-th one."""

    def __init__(self, text, unit="line", every=None, window=None):
        self.text, self.starts, self.every, window = text, UNITS[unit], every or EVERY, window or WINDOW
        self.count, points, at_bytes, at_chars, before = 0, 0, [], [], 10
        for at in range(0, len(text), window):
            part = text[at : at + window]
            starts = self.starts(part, before)
            kept = starts[-self.count % self.every :: self.every]
            if len(kept):
                leads = np.add.accumulate((part[: kept[-1] + 1] & 0xC0) != 0x80, dtype=np.int64)
                at_bytes.append(at + kept)
                at_chars.append(points + leads[kept] - 1)
            points += int(np.count_nonzero((part & 0xC0) != 0x80))
            self.count += len(starts)
            before = part[-1]
        self.points = points
        self.bytes = np.concatenate(at_bytes) if at_bytes else np.empty(0, np.int64)
        self.chars = np.concatenate(at_chars) if at_chars else np.empty(0, np.int64)

    def locate(self, unit):
        """Byte and code-point offset at which a unit starts; those of the text's end for one past the last."""
        if unit >= self.count:
            return len(self.text), self.points
        passed = int(np.searchsorted(np.arange(len(self.bytes)) * self.every, unit, side="right")) - 1
        at, chars = int(self.bytes[passed]), int(self.chars[passed])
        missing, before = unit - passed * self.every, 10  # the checkpoint's own start counts as number 0
        while True:
            part = self.text[at : at + RESCAN]
            starts = self.starts(part, before)
            step = int(starts[missing]) if missing < len(starts) else len(part)
            chars += int(np.count_nonzero((part[:step] & 0xC0) != 0x80))
            at += step
            if missing < len(starts):
                return at, chars
            missing, before = missing - len(starts), part[-1]


def check_marks(marks):
    """Refuses marks that could be read at another place than where they were written."""
    if len(set(marks)) < len(marks):
        raise ValueError("marks are equal")
    for a in marks:
        for b in marks:
            if not a or a != b and a in b or any(a[-k:] == b[:k] for k in range(1, min(len(a), len(b)) + (a != b))):
                raise ValueError(f"marks {a!r} and {b!r} overlap")


def _infill(unit, rate, spm, marks):
    prefix_mark, suffix_mark, middle_mark = (m.encode() for m in marks)

    def infill(batches):
        for batch in batches:
            digests = batch.column(1).to_pylist()
            for a, b, buf, offsets in text_slices(batch.column(0)):
                data, bounds = buf.tobytes(), offsets.tolist()
                counts, forms, prefixes, middles, outputs = [], [], [], [], []
                for i in range(b - a):
                    start, end = bounds[i], bounds[i + 1]
                    index = Checkpoints(buf[start:end], unit)
                    n, digest = index.count, digests[a + i]
                    h1, h2, h3, h4 = (int(digest[k : k + 8], 16) for k in (0, 8, 16, 24))
                    counts.append(n)
                    if start == end or h3 % 100 >= rate or any(data.find(m, start, end) >= 0 for m in (prefix_mark, suffix_mark, middle_mark)):
                        forms.append("plain")
                        prefixes.append(None)
                        middles.append(None)
                        outputs.append(data[start:end])
                        continue
                    (low, low_chars), (high, high_chars) = map(index.locate, sorted((h1 % (n + 1), h2 % (n + 1))))
                    head, middle, tail = data[start : start + low], data[start + low : start + high], data[start + high : end]
                    prefixes.append(low_chars)
                    middles.append(high_chars - low_chars)
                    if h4 % 100 < spm:
                        forms.append("spm")
                        outputs.append(b"".join((suffix_mark, tail, prefix_mark, head, middle_mark, middle)))
                    else:
                        forms.append("psm")
                        outputs.append(b"".join((prefix_mark, head, suffix_mark, tail, middle_mark, middle)))
                kept = [c.slice(a, b - a) for c in batch.columns[2:]]
                made = [pa.array(counts, pa.int64()), pa.array(forms, pa.string()), pa.array(prefixes, pa.int64()), pa.array(middles, pa.int64()), pa.array(outputs, pa.binary()).cast(pa.string(), safe=False)]
                yield pa.RecordBatch.from_arrays([*kept, *made], names=[*batch.schema.names[2:], *NEW])
    return infill


NEW = ("n", "form", "prefix_chars", "middle_chars", "output")


def fill_in_middle(docs, doc_id="doc_id", text="text", unit="line", seed=7, rate=100, spm=50, marks=(PREFIX, SUFFIX, MIDDLE), keep=None):
    """The columns of ``docs`` (or those of ``keep``) with n (units), form (plain, psm or spm), prefix_chars,
    middle_chars (null if plain) and output.

    ``rate`` percent of the texts are changed, ``spm`` percent of these with the suffix first; the marks stand before
    prefix, suffix and middle."""
    check_marks(marks)
    keep = docs.columns if keep is None else list(keep)
    if clash := {c.lower() for c in keep} & set(NEW):
        raise ValueError(f"columns {sorted(clash)} are made here")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), 256)
    source = docs.select(F.col(text).alias("__text"), digest.alias("__digest"), *(docs[c] for c in keep))
    schema = T.StructType([*(docs.schema[c] for c in keep), *T._parse_datatype_string("n long, form string, prefix_chars long, middle_chars long, output string").fields])
    return source.mapInArrow(lean(_infill(unit, rate, spm, tuple(marks))), schema)


def restored(output="output", form="form", marks=(PREFIX, SUFFIX, MIDDLE)):
    """The text from its output and form."""
    out, (p, s, m) = F.col(output), map(F.lit, marks)

    def after(c, mark):
        return F.split_part(c, mark, F.lit(2))

    def before(c, mark):
        return F.split_part(c, mark, F.lit(1))

    head = before(out, m)
    psm = F.concat(after(before(head, s), p), after(out, m), after(head, s))
    spm = F.concat(after(head, p), after(out, m), after(before(head, p), s))
    return F.when(F.col(form) == "psm", psm).when(F.col(form) == "spm", spm).otherwise(out)


def op13_infill(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    made = fill_in_middle(docs, keep=["doc_id"])
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(), 256).alias("restored_sha256"))


SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u,
    sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents
), k AS (
  SELECT doc_id, text, u, len(u) AS n, ('0x' || h[1:8])::UBIGINT % (len(u) + 1)::UBIGINT AS a, ('0x' || h[9:16])::UBIGINT % (len(u) + 1)::UBIGINT AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') THEN 'plain'
      WHEN ('0x' || h[25:32])::UBIGINT % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM d
), c AS (
  SELECT doc_id, text, n, form, array_to_string(u[1:least(a, b)::BIGINT], '') AS p,
    array_to_string(u[least(a, b)::BIGINT + 1:greatest(a, b)::BIGINT], '') AS m, array_to_string(u[greatest(a, b)::BIGINT + 1:], '') AS s FROM k
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM c
"""
