"""BPE encoding and decoding by dynamic programming over the prefixes of each word."""

from __future__ import annotations

import hashlib
import json
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import give_back, small_batches

#: A worker's memory of words: so many bytes at most, about, and no word longer than LONGEST; then it starts anew.
REMEMBERED_BYTES, LONGEST = 96 << 20, 96
#: The same for each of two memories where nothing else runs beside.
CODED_BYTES = 192 << 20
#: Marks a word's end within the automaton; no byte maps to it.
END = "￿"


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    free = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(free)) for b in range(256)]


LETTERS = byte_letters()
#: Single marks that end a word and are words themselves.
ENDS = frozenset(".,;:!?")


def split_words(pattern, text: str) -> list[str]:
    """The words of a text without special tokens, normalized. Letters are lowered one by one: a final sigma is no exception."""
    text = text.lower() if text.isascii() else unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
    if text.isascii() or max(text) < "\u0250":  # what most texts are made of needs no pattern
        if text.isalpha():
            return [text]
        if text[-1:] in ENDS and text[:-1].isalpha():
            return [text[:-1], text[-1]]
    return pattern.findall(text)


def letters_of(word: str) -> str:
    """A word's bytes as letters."""
    return word if word.isascii() and word.isprintable() else "".join([LETTERS[b] for b in word.encode()])


def word_pattern(spec: dict):
    """The pattern of words in a tokenizer file."""
    import regex

    return regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"], regex.V0)


class PrefixBpe:
    """A byte-level BPE vocabulary with word ends, from a tokenizer file.

    BPE gives every prefix of a word exactly one last token: the token that ends there whose left neighbour
    (the last token of what precedes it) stays apart from it. An automaton finds the tokens that end at each
    place, a pair test picks the one, and back-pointers give the ids. Two tokens stay apart if, along the
    right spine of the one and the left spine of the other, no pair would merge before either part is
    taken up by its own token.
    """

    def __init__(self, path: str):
        import ahocorasick
        import regex

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"]
        inner = lambda t: t[: -len(self.suffix)] + END if t.endswith(self.suffix) else t
        self.vocab = {inner(t): i for t, i in model["vocab"].items()}
        self.tokens = {i: t for t, i in model["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens.update({i: t for t, i in self.special.items()})
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        for r, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            left, right = inner(left), inner(right)
            a, b, whole = self.vocab[left], self.vocab[right], self.vocab[left + right]
            self.rank[a, b] = r
            self.parts.setdefault(whole, (a, b, r))
        self.text_of = {i: t for t, i in self.vocab.items()}
        self.words = word_pattern(spec)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.automaton = ahocorasick.Automaton()
        for text, i in self.vocab.items():
            self.automaton.add_word(text, (i, len(text)))
        self.automaton.make_automaton()
        self.apart: dict[int, bool] = {}
        self.whole: list[bool | None] = [None] * (max(self.text_of, default=0) + 1)

    def _spine(self, token: int, side: int) -> list[tuple[int, float]]:
        """(token, rank of the merge that takes it up) from the token itself down one edge."""
        out, taken = [(token, float("inf"))], None
        while taken := self.parts.get(out[-1][0]):
            out.append((taken[side], taken[2]))
        return out

    def stays_apart(self, a: int, b: int) -> bool:
        """Whether the tokens stay apart; remembered under a << 32 | b."""
        if len(self.apart) > 1_000_000:
            self.apart.clear()
        left = self._spine(b, 0)
        # Of two equal merges the left one comes first: hence < on the left side, <= on the right.
        found = not any(r < up and r <= down for x, up in self._spine(a, 1) for y, down in left if (r := self.rank.get((x, y))) is not None)
        self.apart[a << 32 | b] = found
        return found

    def is_whole(self, token: int) -> bool:
        """Whether merging the token's own letters gives the token; remembered."""
        found = self.whole[token]
        if found is None:
            split = self.parts.get(token)
            found = split is None or (self.is_whole(split[0]) and self.is_whole(split[1]) and self._joined(token))
            self.whole[token] = found
        return found

    def _joined(self, token: int) -> bool:
        text = self.text_of[token]
        body, end = (text[:-1], END) if text.endswith(END) else (text, "")
        ids = [self.vocab[c] for c in body[:-1]] + [self.vocab[body[-1] + end]]
        while len(ids) > 1:
            r, k = min((self.rank.get(p, 1 << 60), k) for k, p in enumerate(zip(ids, ids[1:], strict=False)))
            if r == 1 << 60:
                return False
            ids[k : k + 2] = [self.vocab[self.text_of[ids[k]] + self.text_of[ids[k + 1]]]]
        return ids == [token]

    def encode_word(self, letters: str) -> list[int]:
        """Ids of a word that is given by its bytes' letters."""
        word = letters + END
        n = len(word)
        last, begin = [-1] * (n + 1), [0] * (n + 1)
        apart, whole = self.apart.get, self.whole
        for end, (token, size) in self.automaton.iter(word):
            end += 1
            if last[end] >= 0:
                continue
            start = end - size
            if start:
                before = last[start]
                if before < 0:
                    continue
                fits = apart(before << 32 | token)
                if not (self.stays_apart(before, token) if fits is None else fits):
                    continue
            fits = whole[token]
            if self.is_whole(token) if fits is None else fits:
                last[end], begin[end] = token, start
        ids = []
        while n:
            ids.append(last[n])
            n = begin[n]
        return ids[::-1]

    def encode_chunk(self, chunk: str) -> list[int]:
        """Ids of a piece of text without white space, special tokens included."""
        ids: list[int] = []
        for part in self.cut.split(chunk) if self.cut and "<" in chunk else [chunk]:
            if part in self.special:
                ids.append(self.special[part])
                continue
            for word in split_words(self.words, part):
                ids += self.encode_word(letters_of(word))
        return ids


class Remembered(dict):
    """chunk -> made(chunk), of bounded size. ``cost`` is the bytes of what is made, about, beside those of the entry itself.

    Two generations of half the size each: once the young one is full it becomes the old one, out of which what is asked
    for again is taken over, so that common words stay while rare ones come and go.
    """

    def __init__(self, made, cost, most: int = REMEMBERED_BYTES):
        super().__init__()
        self.made, self.cost, self.most, self.held, self.old = made, cost, most // 2, 0, {}

    def __missing__(self, chunk: str):
        found = self.old.get(chunk)
        if found is None:
            found = self.made(chunk)
            if len(chunk) > LONGEST:
                return found
        self.held += 200 + len(chunk) + self.cost(found)
        if self.held > self.most:
            self.old, self.held = dict(self), 0
            self.clear()
        self[chunk] = found
        return found


def chunks_of(text: str) -> list[str]:
    """The runs between white space; the four separators that only Python counts as space stay in the text."""
    if not any(c in text for c in "\x1c\x1d\x1e\x1f"):
        return text.split()
    hidden = str.maketrans("\x1c\x1d\x1e\x1f", "")
    if any(c in text for c in ""):
        import regex

        return [c for c in regex.split(r"\p{White_Space}+", text) if c]
    back = str.maketrans("", "\x1c\x1d\x1e\x1f")
    return [c.translate(back) for c in text.translate(hidden).split()]


_CODERS: dict[str, tuple[PrefixBpe, Remembered]] = {}


def coder(path: str) -> tuple[PrefixBpe, Remembered]:
    """This worker's vocabulary, and its memory of chunks as pairs (ids, tokens) of joined text.

    A chunk is made of words with their case and punctuation, of which there are more than of words, so words are remembered too.
    """
    if path not in _CODERS:
        bpe = PrefixBpe(path)
        cost = lambda pair: 120 + len(pair[0]) + len(pair[1])

        def text_of(ids: list[int]) -> tuple[str, str]:
            return " ".join(map(str, ids)), " ".join(map(bpe.tokens.__getitem__, ids))

        word = Remembered(lambda word: text_of(bpe.encode_word(letters_of(word))), cost, CODED_BYTES).__getitem__
        words = bpe.words

        def made(chunk: str) -> tuple[str, str]:
            if "<" in chunk:
                return text_of(bpe.encode_chunk(chunk))
            pairs = list(map(word, split_words(words, chunk)))
            return pairs[0] if len(pairs) == 1 else (" ".join([p[0] for p in pairs]), " ".join([p[1] for p in pairs]))

        _CODERS[path] = bpe, Remembered(made, cost, CODED_BYTES)
    return _CODERS[path]


def encode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids array<int>) of every whole text; null and empty texts have no ids. Repeated rows stay."""

    def run(batches):
        bpe, _ = coder(path)
        for batch in batches:
            ids = [[i for c in chunks_of(t or "") for i in bpe.encode_chunk(c)] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=[key, "ids"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, ids array<int>")


def decode(encoded: DataFrame, path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(key, text): the tokens of the ids, joined by spaces, as a file without a decoder asks. Null ids give a null text; unknown ids are left out."""

    def run(batches):
        tokens = coder(path)[0].tokens
        for batch in batches:
            texts = [None if row is None else " ".join(tokens[i] for i in row if i in tokens) for row in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[key, "text"])

    return encoded.select(key, ids).mapInArrow(run, f"`{key}` {encoded.schema[key].dataType.simpleString()}, text string")


def digests(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_tokens, ids_sha256, decoded_sha256 of every whole text: ``encode`` then ``decode`` in one pass that keeps no ids.

    Null and empty texts have no tokens and the digests of an empty text; repeated rows and any keys stay as they are.
    """

    def run(batches):
        _, known = coder(path)
        get = known.__getitem__
        for batch in batches:
            counts, ids_sha, text_sha = [], [], []
            for t in batch.column(1):
                pairs = list(map(get, chunks_of(t.as_py() or "")))
                ids = " ".join([p[0] for p in pairs])
                counts.append(ids.count(" ") + 1 if ids else 0)
                ids_sha.append(hashlib.sha256(ids.encode()).hexdigest())
                text_sha.append(hashlib.sha256(" ".join([p[1] for p in pairs]).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], names=[key, "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
