"""Column expressions over text: tokens, fuzzy matching, previews, JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


# White space as JavaScript knows it, for use inside a character class; Java's own class is ASCII.
JS_SPACE = r"\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"


def js_length(text: Column) -> Column:
    """Length in UTF-16 units, as the wire limits count it."""
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("bigint")


def longer_than(text: Column, limit: int) -> Column:
    """``js_length(text) > limit``; text far from the limit is not encoded."""
    code_points = F.length(text)
    return (
        F.when(code_points > limit, True)
        .when(code_points * 2 <= limit, False)
        .otherwise(js_length(text) > limit)
    )


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters, digits and underscores."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1))


def fuzziness(term: str) -> int:
    """Edits allowed for a term: none up to 2 characters, one up to 5, else two."""
    return 0 if len(term) <= 2 else 1 if len(term) <= 5 else 2


def _swapped(word: Column, at: Column) -> Column:
    """The two characters from position ``at`` in reverse order."""
    return F.concat(F.substring(word, at + 1, F.lit(1)), F.substring(word, at, F.lit(1)))


def _one_edit(a: Column, b: Column) -> Column:
    swap = F.exists(
        F.sequence(F.lit(1), F.length(a) - 1),
        lambda i: F.concat(
            F.substring(a, F.lit(1), i - 1), _swapped(a, i), F.substring(a, i + 2, F.length(a))
        )
        == b,
    )
    return (F.levenshtein(a, b, 1) >= 0) | (
        (F.length(a) == F.length(b)) & (F.length(a) >= 2) & (a != b) & swap
    )


def within_edits(word: Column, term: str) -> Column:
    """Optimal-string-alignment distance of ``word`` to ``term`` within its fuzziness.

    Two edits with a transposition: the swapped pair stays as it is, so the other
    edit lies wholly before or wholly after it.
    """
    limit = fuzziness(term)
    target = F.lit(term)
    if limit == 0:
        return word == term
    near = (F.length(word) - len(term)).between(-limit, limit)
    if limit == 1:
        return near & _one_edit(word, target)

    def around_swap(i: Column) -> Column:
        # Only positions of the pair in the term within one shift are possible.
        pair = _swapped(word, i)
        head, tail = F.substring(word, F.lit(1), i - 1), F.substring(word, i + 2, F.length(word))
        edit_after = target.startswith(F.concat(head, pair)) & _one_edit(
            tail, F.substring(target, i + 2, F.lit(len(term)))
        )
        edit_before = target.endswith(F.concat(pair, tail)) & _one_edit(
            head, F.substring(target, F.lit(1), F.lit(len(term)) - F.length(tail) - 2)
        )
        return edit_after | edit_before

    swap = (F.length(word) >= 2) & F.exists(
        F.sequence(F.lit(1), F.greatest(F.length(word) - 1, F.lit(1))), around_swap
    )
    # A swap costs two plain edits: plain distance above 4 rules everything out.
    return near & (
        (F.levenshtein(word, target, 2) >= 0)
        | (F.levenshtein(word, target, 4) >= 0) & swap
    )


def time_ago(at: Column, as_of: Column) -> Column:
    """Age as short text, such as ``5m ago``."""
    millis = F.unix_millis(as_of) - F.unix_millis(at)

    def unit(size: int, suffix: str) -> Column:
        return F.concat(F.floor(millis / size).cast("string"), F.lit(suffix))

    return (
        F.when(millis < 10_000, "just now")
        .when(millis < 60_000, unit(1_000, "s ago"))
        .when(millis < 3_600_000, unit(60_000, "m ago"))
        .when(millis < 86_400_000, unit(3_600_000, "h ago"))
        .otherwise(unit(86_400_000, "d ago"))
    )


def chat_messages(text: Column) -> Column:
    """Array of (role, content) if ``text`` is a chat transcript in JSON, else null.

    A transcript is a non-empty array of objects that all have a string ``role``
    and some ``content``. Content that is not a string stays JSON text.
    """
    raw = F.from_json(text, "array<variant>")
    parsed = F.when(F.ltrim(text).startswith("["), raw)
    is_message = lambda m: (
        F.schema_of_variant(m).startswith("OBJECT")
        & (F.schema_of_variant(F.variant_get(m, "$.role", "variant")) == "STRING")
        & F.variant_get(m, "$.content", "variant").isNotNull()
    )
    valid = (F.size(parsed) > 0) & F.forall(parsed, lambda m: F.coalesce(is_message(m), F.lit(False)))
    return F.when(
        valid,
        F.transform(
            parsed,
            lambda m: F.struct(
                F.variant_get(m, "$.role", "string").alias("role"),
                F.variant_get(m, "$.content", "string").alias("content"),
            ),
        ),
    )


def json_number(value: Column) -> Column:
    """A JSON number held in a VARIANT, as double; null for anything else.

    Reading a VARIANT as another type than its own builds a cast object per row,
    so integers are read as such and other numbers from their text.
    """
    kind = F.schema_of_variant(value)
    return F.when(
        kind == "BIGINT", F.try_variant_get(value, "$", "bigint").cast("double")
    ).when((kind == "DOUBLE") | kind.startswith("DECIMAL"), F.to_json(value).try_cast("double"))


def metadata_get(metadata: Column, path: str, kind: str = "string") -> Column:
    """Value at a JSON path of the metadata text; null where it cannot be read."""
    return F.try_variant_get(F.try_parse_json(metadata), path, kind)


def normalize_message(message: Column) -> Column:
    """Replace ids and numbers in an error message by placeholders."""
    text = F.regexp_replace(
        message,
        r"(?i)(?<![0-9a-z])[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}(?![0-9a-z])",
        "<uuid>",
    )
    text = F.regexp_replace(text, r"(?i)(?<![0-9a-z])(?:0x[0-9a-f]+|(?=[a-f]*\d)(?=\d*[a-f])[0-9a-f]{8,})(?![0-9a-z])", "<hex>")
    return F.regexp_replace(text, r"\d+(?:\.\d+)?", "<num>")
