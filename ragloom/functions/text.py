"""Text functions as column expressions: Unicode tokens, normal forms, overlaps, templates, context blocks."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters, digits and the underscore of any script; Java's own \w is ASCII only.
TOKEN = r"[\p{L}\p{N}_]+"
BOUNDARY = r"[\p{L}\p{N}_]"

# Fixed value: the function words that content words leave out.
CONTENT_STOP_WORDS = (
    "the a an and or of in on to for with is are was be by at as from that this it its their his her they them which what who "
    "most common popular usually people often also one some"
).split()

#: Default stop words of the index; any other list can be given.
INDEX_STOP_WORDS = "a an and are as at be by for from has he in is it its of on or that the this to was were will with".split()


def strings(words: Iterable[str]) -> Column:
    return F.array(*[F.lit(w) for w in words])


def tokens(text: Column) -> Column:
    """Tokens in order, repeats kept; a null text has none."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


def without(words: Column, stop: Iterable[str]) -> Column:
    """Drop stop words and keep repeats (`array_except` would drop those)."""
    drop = list(stop)
    return F.filter(words, lambda w: ~w.isin(drop)) if drop else words


def index_tokens(text: Column, stop: Iterable[str] = INDEX_STOP_WORDS) -> Column:
    return without(tokens(text), stop)


def split_terms(lowered, stop: Iterable[str] = INDEX_STOP_WORDS):
    """`index_tokens` of an Arrow array of lower-cased texts, for use within tasks: all tokens in order, and the row of each."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    blanks = np.array([i if i > 127 or chr(i).isalnum() or i == ord("_") else 32 for i in range(256)], "uint8")
    valid, offsets, data = lowered.buffers()
    plain = pa.py_buffer(blanks[np.frombuffer(data or b"", "uint8")])
    texts = pa.Array.from_buffers(lowered.type, len(lowered), [valid, offsets, plain], lowered.null_count, lowered.offset)
    other = r"[^\x00-\x7F\p{L}\p{N}]"
    odd = pc.fill_null(pc.match_substring_regex(texts, other), False)
    texts = pc.replace_with_mask(texts, odd, pc.replace_substring_regex(texts.filter(odd), other, " "))
    lists = pc.split_pattern(texts, " ")
    own = np.repeat(np.arange(len(lists)), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    words = lists.flatten()
    keep = pc.invert(pc.is_in(words, value_set=pa.array(["", *stop], words.type)))
    return words.filter(keep), own[keep.to_numpy(zero_copy_only=False)]


def content_words(text: Column, stop: Iterable[str] = CONTENT_STOP_WORDS) -> Column:
    """The set of words of three letters or more that aren't stop words."""
    drop = list(stop)
    return F.array_distinct(F.filter(tokens(text), lambda w: (F.length(w) > 2) & ~w.isin(drop)))


def phrases(text: Column, n: int) -> Column:
    """All runs of `n` consecutive tokens, joined by one blank, repeats kept."""

    def runs(w: Column) -> Column:
        every = F.transform(F.sequence(F.lit(1), F.size(w) - (n - 1)), lambda i: F.array_join(F.slice(w, i, n), " "))
        return F.when(F.size(w) >= n, every).otherwise(F.array().cast("array<string>"))

    return F.transform(F.array(tokens(text)), runs)[0]  # the outer array binds the tokens, so that they are made once


def normalize(text: Column) -> Column:
    return F.array_join(tokens(text), " ")


def overlap_share(own: Column, reference: Column) -> Column:
    """Share of the words of set `own` that `reference` has; 0 for an empty set."""
    return F.when(F.size(own) > 0, F.size(F.array_intersect(own, reference)) / F.size(own).cast("double")).otherwise(F.lit(0.0))


def mentions(normal_text: Column, normal_phrase: Column) -> Column:
    """Whether a phrase stands in a text as whole words; both in normal form, which escapes any pattern character."""
    return F.contains(F.concat(F.lit(" "), normal_text, F.lit(" ")), F.concat(F.lit(" "), normal_phrase, F.lit(" "))) & (normal_phrase != "")


def fill(template: Column, slot: str, value: Column) -> Column:
    """Literal substitution of `{slot}`."""
    return F.replace(template, F.lit("{" + slot + "}"), F.coalesce(value, F.lit("")))


def fill_all(template: str, values: dict[str, Column]) -> Column:
    """Substitution of all slots in one pass: what a value brings in is never expanded again."""
    parts: list[Column] = []
    rest = template
    while rest:
        at = min((i for i in (rest.find("{" + k + "}") for k in values) if i >= 0), default=-1)
        if at < 0:
            parts.append(F.lit(rest))
            break
        slot = next(k for k in values if rest.startswith("{" + k + "}", at))
        parts += [F.lit(rest[:at]), F.coalesce(values[slot].cast("string"), F.lit(""))]
        rest = rest[at + len(slot) + 2 :]
    return F.concat(*parts)


def numbered(texts: Column) -> Column:
    """`[1] first`, `[2] second`, one per line."""
    return F.array_join(F.transform(texts, lambda t, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), t)), "\n")


# The prompts' headers.
HEADERS = {
    "v1": "Background information about {place} (may or may not be relevant):",
    "v2": (
        "Background information about {place}. Use it only if it directly helps to answer the question; otherwise ignore it and answer "
        "from your own knowledge. Always give an answer and never say that the information is not provided."
    ),
}


def context_block(place: Column, texts: Column, version: str = "v1") -> Column:
    """Header, numbered texts and an empty line; nothing at all without texts."""
    block = F.concat(fill_all(HEADERS[version], {"place": place}), F.lit("\n"), numbered(texts), F.lit("\n\n"))
    return F.when(F.size(texts) > 0, block).otherwise(F.lit(""))


# Fixed value: the judge's question.
JUDGE = """You check whether background notes answer a question about everyday life in {country}.

Question: {question}

Background notes:
{notes}

Do the background notes explicitly state an answer to this question (not just mention the topic)?
Reply with only YES or NO."""


def listed(texts: Column) -> Column:
    """`- first`, `- second`, one per line."""
    return F.array_join(F.transform(texts, lambda t: F.concat(F.lit("- "), t)), "\n")


def judge_prompt(country: Column, question: Column, texts: Column) -> Column:
    """Underscores of a country's name become blanks."""
    return fill_all(JUDGE, {"country": F.translate(country, "_", " "), "question": question, "notes": listed(texts)})


Normaliser = Callable[[Column], Column]


def normalised_by(language: Column, text: Column, registry: dict[str, Normaliser]) -> Column:
    """Base forms by the language's own normaliser. One that isn't registered is an error only when a row of it is reached, so
    that languages nobody uses need no tool."""
    out = F.raise_error(F.concat(F.lit("no normaliser for "), F.coalesce(language, F.lit("null")))).cast("array<string>")
    for name, base in registry.items():
        out = F.when(language == name, base(text)).otherwise(out)
    return out


def has_normaliser(language: Column, registry: dict[str, Normaliser]) -> Column:
    """Rows to keep where languages without a tool are skipped; a null language has none."""
    return F.coalesce(language.isin(list(registry)), F.lit(False))


def index_text(text: Column, keywords: Column) -> Column:
    """Card text and its keywords, as the index takes them; the blank stays when there are none."""
    return F.concat(F.coalesce(text, F.lit("")), F.lit(" "), F.array_join(F.coalesce(keywords, F.array().cast("array<string>")), " "))


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(F.trim(F.coalesce(text, F.lit(""))), r"\s+"), lambda w: w != ""))


def clean_response(response: Column, prompt: Column | None = None, labels: Iterable[str] = ("answer", "response")) -> Column:
    """Drop the prompt's echo and a leading label, lower the case, drop full stops at the end."""
    out = F.coalesce(response, F.lit(""))
    if prompt is not None:
        out = F.replace(out, prompt, F.lit(""))
    out = F.lower(F.trim(out))
    out = F.regexp_replace(out, "^(" + "|".join(labels) + r")\s*:\s*", "")
    return F.trim(F.regexp_replace(F.trim(out), r"\.+$", ""))


def composite_key(*parts: Column, separator: str = "|") -> Column:
    return F.concat_ws(separator, *[p.cast("string") for p in parts])
