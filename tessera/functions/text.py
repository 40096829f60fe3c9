"""Text normalisation, word shingles, answer labels and personal data, as columns.

Native functions wherever Spark has one; Unicode normalisation and case folding have
none and run in Python over Arrow batches.
"""

from __future__ import annotations

import re
import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.shingle_numbers import numbered

#: fixed values: long dashes and the no-break space
DASHES_FROM = "—–‑ "
DASHES_TO = "--- "
#: fixed values: patterns of personal data and what replaces them, applied in this order
PHONE = r"(?:\+7|\b8)[\s\-(]{0,3}\d{3}[\s\-)]{0,3}\d{3}[\s\-]?\d{2}[\s\-]?\d{2}\b"
EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"
BIRTH_DATE = r"((?:дат[аеы]\s+рождения|год\s+рождения|родил(?:ся|ась)|\bг\.\s?р\.|\bд\.\s?р\.)\s*[:\-—]?\s*)(?:0?[1-9]|[12]\d|3[01])[.\-/](?:0?[1-9]|1[0-2])[.\-/](?:19|20)\d{2}\b"
PERSONAL = (("phone", "(?U)" + PHONE, "[PHONE]"), ("email", "(?U)" + EMAIL, "[EMAIL]"), ("birth_date", "(?iuU)" + BIRTH_DATE, "$1[DATE]"))
WORD = r"[\p{L}\p{N}_]+"


#: texts that are Python objects at once, whatever the size of a batch
SLICE = 256


def _mapped(of):
    """A function of columns that applies ``of``, from str to str, to each text that is not null.

    A batch stays in Arrow's form, as Python holds a text in several times its bytes; only a slice of it is objects at a time."""

    @F.arrow_udf("string")
    def run(texts: pa.Array) -> pa.Array:
        parts = []
        for i in range(0, len(texts), SLICE):
            part = texts.slice(i, SLICE)
            parts.append(pa.nulls(len(part), pa.string()) if part.null_count == len(part) else pa.array([None if t is None else of(t) for t in part.to_pylist()], pa.string()))
        return pa.concat_arrays(parts) if parts else pa.array([], pa.string())

    return run


def _normalized(form: str):
    return _mapped(lambda t: t if t.isascii() else unicodedata.normalize(form, t))


def is_ascii(text: Column) -> Column:
    return F.length(text) == F.octet_length(text)


def _beyond(plain: Column, native: Column, of, text: Column) -> Column:
    """``native`` where ``plain``; other rows go through ``of``, a Python function, which sees null for the plain ones."""
    return F.when(plain, native).otherwise(of(F.when(~plain, text)))


def nfkc(text: Column) -> Column:
    return _beyond(is_ascii(text), text, _normalized("NFKC"), text)


def nfc(text: Column) -> Column:
    return _beyond(is_ascii(text), text, _normalized("NFC"), text)


def casefold(text: Column) -> Column:
    """Full case folding ('ß' to 'ss'), which lower() is not."""
    return _beyond(is_ascii(text), F.lower(text), _mapped(str.casefold), text)


def squeeze(text: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def normalize_text(text: Column, compose: bool = True) -> Column:
    """Canonical form for comparing texts: NFKC, plain dashes, single spaces, lower case."""
    text = nfkc(text) if compose else text
    for dash, plain in zip(DASHES_FROM, DASHES_TO, strict=True):  # few texts have any: looking for one is cheaper than translate(), which takes each character
        text = F.replace(text, F.lit(dash), F.lit(plain))
    return F.lower(squeeze(text))


def normalize_group(topic: Column, compose: bool = True) -> Column:
    """The canonical group: what comes before the first bar."""
    return normalize_text(F.substring_index(topic, "|", 1), compose)


def normalize_source(text: Column) -> Column:
    """For source columns: NFC and single spaces, null as empty; case stays."""
    return squeeze(nfc(F.coalesce(text, F.lit(""))))


def normalize_answer(text: Column) -> Column:
    """For answers and labels: case-folded, single spaces."""
    return squeeze(casefold(text))


#: fixed value: a numbered or lettered answer option, a whole line
_OPTION = re.compile(r"^\s*(?:\d+|[a-zа-я])\s*[.)]\s*(\S.*)$", re.IGNORECASE)
#: what any line of that form has, for ASCII texts
_MAYBE_OPTION = r"(?:^|[\n\x0b\x0c\r\x1c-\x1e])[\s\x1c-\x1f]*(?:\d+|[A-Za-z])[\s\x1c-\x1f]*[.)]"


def _plain(line: str) -> str:
    return " ".join(line.split()).lower()


def order_options(text: str | None) -> str | None:
    """Neighbouring numbered lines, two or more, without numbers and sorted; all lines normalised, empty ones dropped."""
    if text is None:
        return None
    runs: list[tuple[bool, list[str]]] = []
    text = unicodedata.normalize("NFKC", text)  # once: parts of a composed text are composed
    for dash, plain in zip(DASHES_FROM, DASHES_TO, strict=True):
        text = text.replace(dash, plain)
    for line in text.splitlines():
        option = _OPTION.fullmatch(line)
        kept = _plain(option[1] if option else line)
        if not runs or runs[-1][0] is not bool(option):
            runs.append((bool(option), []))
        if kept or option:
            runs[-1][1].append(kept)
    return "\n".join(line for numbered, lines in runs for line in (sorted(lines) if numbered else lines))


def canonical_options(text: Column) -> Column:
    return _mapped(order_options)(text)


def comparable(text: Column) -> Column:
    """The text whose words are compared for near-duplicates: that of canonical_options(), or one with the same words.

    ASCII texts without a line that may be an option are left as they are."""
    text = F.coalesce(text, F.lit(""))
    return _beyond(is_ascii(text) & ~text.rlike(_MAYBE_OPTION), text, _mapped(order_options), text)


def let(value: Column, use) -> Column:
    """``use(value)`` with the value evaluated once, also where ``use`` has lambdas."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def words(text: Column) -> Column:
    """Words of letters, digits and underscores in any script, lower-cased; null has none."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def shingles_of(word_array: Column, size: int) -> Column:
    """Distinct runs of ``size`` words; a shorter text is one shingle, an empty one has none.

    ``word_array`` must be a column that is stored, not computed: it is read once a shingle."""
    if size < 1:
        raise ValueError("a shingle has at least one word")
    n = F.size(word_array)
    runs = F.transform(F.sequence(F.lit(1), n - size + 1), lambda i: F.array_join(F.slice(word_array, i, F.lit(size)), " "))
    return F.when(n >= size, F.array_distinct(runs)).when(n > 0, F.array(F.array_join(word_array, " "))).otherwise(F.array().cast("array<string>"))


def spaced_words(text: Column) -> Column:
    """words() in one text, with single spaces."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}_]+", " "))


def shingle_numbers(spaced: Column, size: int) -> Column:
    """The shingles of shingles_of() as sorted distinct 32-bit numbers, the first eight hex digits of their md5; ``spaced`` is from spaced_words()."""
    if size < 1:
        raise ValueError("a shingle has at least one word")

    @F.arrow_udf("array<bigint>")
    def run(texts: pa.Array) -> pa.Array:
        parts = [numbered(texts.slice(i, SLICE), size) for i in range(0, len(texts), SLICE)]
        return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.int64()))

    return run(spaced)


def shingle_hashes(text: Column, size: int) -> Column:
    """The shingles as sorted distinct 64-bit hashes; the order of numbered answer options plays no part."""
    if size < 1:
        raise ValueError("a shingle has at least one word")

    def of(w: Column) -> Column:
        n = F.size(w)
        runs = F.transform(F.sequence(F.lit(1), n - size + 1), lambda i: F.xxhash64(F.slice(w, i, F.lit(size))))
        return F.when(n >= size, F.array_sort(F.array_distinct(runs))).when(n > 0, F.array(F.xxhash64(w))).otherwise(F.array().cast("array<bigint>"))

    return let(words(comparable(text)), of)


def label_set(text: Column) -> Column:
    """A comma-separated list as a set of labels, each normalised as normalize_text() does."""

    # label by label: what NFKC makes a comma separates nothing
    composed = _mapped(lambda t: "\x00".join(unicodedata.normalize("NFKC", x) for x in t.split(",")))
    text = F.coalesce(text, F.lit(""))
    whole = _beyond(is_ascii(text), F.replace(text, F.lit(","), F.lit("\x00")), composed, text)
    parts = F.transform(F.split(whole, "\x00"), lambda x: F.lower(squeeze(F.translate(x, DASHES_FROM, DASHES_TO))))
    return F.array_distinct(F.filter(parts, lambda x: x != ""))


def canonical_answer(text: Column) -> Column:
    """Case-folded labels without white space around them, sorted and joined with ', '; null where one is empty or repeated."""
    parts = F.transform(F.split(casefold(text), ","), lambda x: F.regexp_replace(x, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", ""))
    good = F.forall(parts, lambda x: x != "") & (F.size(F.array_distinct(parts)) == F.size(parts))
    return F.when(good, F.array_join(F.array_sort(parts), ", "))


def map_labels(labels: Column, aliases: dict[str, str]) -> Column:
    """Sorted distinct canonical names of the labels that have one."""
    lookup = F.create_map(*[F.lit(x) for pair in sorted(aliases.items()) for x in pair])
    return F.array_sort(F.array_distinct(F.filter(F.transform(labels, lambda x: F.try_element_at(lookup, x)), lambda x: x.isNotNull())))


def mask_personal(text: Column) -> tuple[Column, dict[str, Column]]:
    """The text with personal data replaced, and how many of each kind; a kind is counted in what the kinds before left."""
    counts = {}
    for name, pattern, placeholder in PERSONAL:
        counts[name] = F.regexp_count(text, F.lit(pattern)).cast("long")
        text = F.regexp_replace(text, pattern, placeholder)
    return text, counts


def iso_date(text: Column) -> Column:
    """A date written exactly yyyy-mm-dd; anything else is null."""
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(text, "yyyy-MM-dd"))


def cpu_cores(quantity: Column) -> Column:
    """'250m' as 0.25, '2' as 2."""
    return F.when(F.endswith(quantity, F.lit("m")), F.try_divide(F.expr("0.0D") + F.regexp_replace(quantity, "m$", "").cast("double"), F.lit(1000.0))).otherwise(quantity.cast("double"))
