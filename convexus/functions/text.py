"""Text features, answer labels, prompts and word interventions."""

from __future__ import annotations

from pyspark.sql import functions as F

from .hashing import stable_key

#: Negation markers, as words of their own.
NEGATIONS = ["not", "no", "never", "none", "nothing", "nowhere", "hardly", "barely", "scarcely", "without"]
#: Patterns of an answer that is named, of a letter that stands alone, and of the end of reasoning.
ANSWER = r"(?is)answer\s*(?:is|:)?\s*\(?([A-J])\)?"
ALONE = r"(?i)(?<![A-Za-z0-9])\(?([A-J])\)?(?![A-Za-z0-9])"
REASONED = r"(?is)^.*(?:</think>|</analysis>|final\s*:)"
LETTERS = "ABCDEFGHIJ"


def words(text):
    """The runs without white space (ASCII)."""
    return F.filter(F.split(text, r"[ \t\n\r\f\x0B]+"), lambda w: w != "")


def bucket_length(n):
    """Short up to 7 words, medium up to 15, long above."""
    return F.when(n <= 7, "short").when(n <= 15, "medium").otherwise("long")


def bucket_sentiment(p):
    """By a positive-class probability: strong at 0.2 and below or 0.8 and above."""
    return F.when(p <= 0.2, "negative").when(p >= 0.8, "positive").otherwise("ambiguous")


def has_negation(text):
    """A marker between blanks, or at the beginning or end next to one; or the ending of a contraction."""
    marks = "|".join(NEGATIONS)
    return F.lower(text).rlike(rf"(?s)n't| ({marks}) |\A({marks}) | ({marks})\z")


def fold(text):
    """Lower case, runs of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(text), r"[ \t\n\r\f\x0B]+", " "))


def contains_folded(text, needle):
    """Whether a text holds a needle, letter case and runs of white space aside; an empty needle is in no text."""
    return (F.length(fold(needle)) > 0) & F.contains(fold(text), fold(needle))


def round_half_up(x):
    return F.floor(x + 0.5).cast("int")


def first_label(text, n_options: int):
    """The first standalone option letter that the options have."""
    found = F.regexp_extract_all(text, F.lit(r"(?:^|[^A-Za-z])([A-J])(?:[^A-Za-z]|$)"), F.lit(1))
    return F.get(F.filter(found, lambda c: F.contains(F.lit(LETTERS[:n_options]), c)), F.lit(0))


def final_label(text, n_options: int):
    """(label, method) from the last 4096 characters: the last answer that is named, else the last letter that stands alone, else the last such letter after the end of reasoning, else null."""
    tail = F.right(text, F.lit(4096))
    own = lambda found: F.filter(F.transform(found, F.upper), lambda c: F.contains(F.lit(LETTERS[:n_options]), c))
    named = own(F.regexp_extract_all(tail, F.lit(ANSWER), F.lit(1)))
    alone = own(F.regexp_extract_all(tail, F.lit(ALONE), F.lit(1)))
    after = own(F.regexp_extract_all(F.when(tail.rlike(REASONED), F.regexp_replace(tail, REASONED, "")), F.lit(ALONE), F.lit(1)))
    last = lambda a: F.when(F.size(a) > 0, F.element_at(a, -1))
    method = F.when(F.size(named) > 0, "explicit_final_answer").when(F.size(alone) > 0, "final_standalone_label").when(F.size(after) > 0, "post_reasoning_delimiter")
    return F.coalesce(last(named), last(alone), last(after)), method.otherwise("unresolved")


def prompt(question, options):
    """A question, its lettered options and the request for one letter."""
    lines = F.transform(options, lambda o, i: F.concat(F.substring(F.lit(LETTERS), i + 1, F.lit(1)), F.lit(". "), o))
    return F.concat(question, F.lit("\n"), F.array_join(lines, "\n"), F.lit("\nAnswer with one letter."))


def eligible(word):
    """Words of three letters or more, all letters."""
    return word.rlike("^[A-Za-z]{3,}$")


def mark_first(tokens, hashes, k, mark: str):
    """``tokens`` with the k of least hash replaced by ``mark``.

    ``hashes`` makes a hash of (word, place). The row's tokens are sorted by hash, cut at k and sorted back, so
    nothing is computed twice or once for each pair of tokens, as a lookup within a lambda would be.
    """
    order = F.array_sort(F.transform(tokens, lambda w, i: F.struct(hashes(w, i).alias("h"), i.alias("i"), w.alias("w"))))
    # The count goes with every element, so that it is computed once and not in the lambda.
    pairs = F.arrays_zip(order.alias("s"), F.array_repeat(k, F.size(tokens)).alias("k"))
    marked = F.transform(pairs, lambda p, j: F.struct(p["s"]["i"].alias("i"), F.when(j < p["k"], F.lit(mark)).otherwise(p["s"]["w"]).alias("w")))
    return F.transform(F.array_sort(marked), lambda s: s["w"])


def blank_words(tokens, key, share: float, seed: str):
    """A copy of ``tokens`` with the first floor(share * n + 0.5) eligible ones, in hash order, blanked.

    Smaller shares blank a subset of what larger ones do. All within the row: no token leaves it.
    """
    k = round_half_up(F.size(F.filter(tokens, eligible)) * share)
    # Hashes are hexadecimal, so words that aren't eligible come last.
    return mark_first(tokens, lambda w, i: F.when(eligible(w), stable_key(seed, key, i.cast("string"))).otherwise("z"), k, "___")


#: Addresses, with letters that run into them, and words of letters.
ADDRESS, LETTERED = r"[A-Za-z']*?(?:https?://\S+|www\.\S+)", r"[A-Za-z]+(?:'[A-Za-z]+)?"


def delete_words(text, key, track, share: float, seed: str, stopwords: list[str]):
    """(text, n_eligible, n_deleted): ``text`` with the first floor(share * n + 0.5) of its n eligible words, in hash order, blanked in place.

    Eligible are words of three letters or more that are no stopwords and no part of an address; their order hashes (seed, key,
    track, place among the eligible, word in lower case), so smaller shares blank a subset of what larger ones do. The
    text between words stays as it is. All within the row, by sorts.
    """
    pieces = F.regexp_extract_all(text, F.lit(rf"(?is){ADDRESS}|{LETTERED}|[^A-Za-z]"), F.lit(0))
    all_ = F.transform(pieces, lambda w, i: F.struct(i.alias("i"), w.alias("w")))
    long = lambda w: F.length(F.replace(w, F.lit("'"), F.lit(""))) >= 3
    fits = lambda s: s["w"].rlike(rf"^{LETTERED}$") & long(s["w"]) & ~F.lower(s["w"]).isin(stopwords)

    def marked(own):
        ranked = F.array_sort(F.transform(own, lambda s, k: F.struct(stable_key(seed, key, track, k.cast("string"), F.lower(s["w"])).alias("h"), k.alias("k"), s["i"].alias("i"), s["w"].alias("w"))))
        n = round_half_up(F.size(own) * share)
        return F.transform(F.arrays_zip(ranked.alias("s"), F.array_repeat(n, F.size(own)).alias("n")), lambda p, j: F.struct(p["s"]["i"].alias("i"), F.when(j < p["n"], F.lit("___")).otherwise(p["s"]["w"]).alias("w")))

    own = F.filter(all_, fits)
    whole = F.array_sort(F.concat(marked(own), F.filter(all_, lambda s: ~fits(s))))
    return F.array_join(F.transform(whole, lambda s: s["w"]), ""), F.size(own), round_half_up(F.size(own) * share)
