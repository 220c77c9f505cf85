"""Byte-pair encoding of whole texts as a streaming transducer, and decoding back.

*Lookahead.* Merges apply in the order of their list, so two strings with a common prefix
have the same tokens in that prefix up to some distance from its end: reading on can only
take away tokens from the right, one merge after the other, each eating the last token that
both still agree on. Merge (u, v) can follow such a step that ate t only where t begins v,
that is, where t is v or the left part of v, or of that part, and so on. The longest chain
of such steps, in the order of the list, is the sufficient lookahead (``lookahead``). With
the tokens of what has been read so far, all that end before it are final.

*Encoding.* A text is read in chunks that end before white space where there is any. A
chunk is normalised and cut into words by the vocabulary's own rules. A word in one chunk is
merged at once, and remembered while the bounded table of words has room; a word that no
chunk holds whole is fed to a ``Stream``, which emits tokens as soon as they are final and
keeps at most a window of its bytes. Memory does not grow with the text or with a word.

*Decoding.* Tokens become bytes, and bytes become text in a state machine that holds at
most an unfinished character. What cannot be text becomes U+FFFD.

Vocabularies are files of the public ``tokenizers`` format with a BPE model over byte
letters whose merge list makes every part before it is used (else ``ValueError``). Of that
library only the normaliser is used, for characters whose normal form depends on the
Unicode version, and its pattern engine, for those that this Python has no name for yet.

Defined results: null is the empty text and has no tokens; the strings of special tokens
in a text are these tokens, as in that library; repeated rows are each encoded; a null id
stays null; an empty table gives no rows. A run of combining marks is normalised whole.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
import unicodedata
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/word_bpe_49k.json"
CHUNK = 1 << 16  # characters
WINDOW = 512  # bytes of a long word that are merged at a time, beside the lookahead
REMEMBERED = 1 << 18  # words
LONGEST_REMEMBERED = 64  # characters
SHIFT = 24  # bits of a token's number
LOW, NONE = (1 << SHIFT) - 1, 1 << 62
# Below it, characters have the same normal form and case in every Unicode version in use.
SETTLED = "԰"


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in a vocabulary of byte letters."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(0x100)]


def lookahead(merges: list[tuple[int, int, int]], lengths: dict[int, int]) -> int:
    """The sufficient lookahead of a merge list, in the unit of ``lengths``.

    merges: (left, right, merged) tokens in order; lengths: of every token.
    """
    lefts: dict[int, list[int]] = {}
    for left, _, merged in merges:
        lefts.setdefault(merged, []).append(left)
    eaten: dict[int, int] = {}  # the longest chain so far whose last step ate this token
    for left, right, _ in merges:
        before, begins, seen = 0, [right], set()
        while begins:
            token = begins.pop()
            if token not in seen:
                seen.add(token)
                before = max(before, eaten.get(token, 0))
                begins += lefts.get(token, ())
        eaten[left] = max(eaten.get(left, 0), lengths[left] + before)
    return max(eaten.values(), default=0)


class Merger:
    """Merges of a vocabulary over tokens."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str = "") -> None:
        if max(vocab.values(), default=0) > LOW:
            raise ValueError("token numbers of more than 24 bits")
        letters = byte_letters()
        self.inner = [vocab[c] for c in letters]
        self.final = [vocab[c + suffix] for c in letters]
        # Both tokens of a merge in one number, and its rank and what it makes in another.
        self._known: dict[int, int] = {}
        lengths = dict.fromkeys([*self.inner, *self.final], 1)
        listed = []
        for rank, (left, right) in enumerate(merges):
            a, b, merged = vocab[left], vocab[right], vocab[left + right]
            if a not in lengths or b not in lengths:
                raise ValueError(f"merge {rank} uses a token that no earlier merge makes")
            lengths[merged] = lengths[a] + lengths[b]
            self._known.setdefault(a << SHIFT | b, rank << SHIFT | merged)
            listed.append((a, b, merged))
        self.lengths = lengths
        self.lookahead = lookahead(listed, lengths)

    def merge(self, tokens: list[int]) -> list[int]:
        """All merges, the first of the list first, of equal ones the leftmost."""
        return self._merge_short(tokens) if len(tokens) <= 32 else self._merge_long(tokens)

    def _merge_short(self, tokens: list[int]) -> list[int]:
        known, tokens = self._known.get, list(tokens)
        found = [known(a << SHIFT | b, NONE) for a, b in zip(tokens, tokens[1:])]
        while found and (best := min(found)) < NONE:
            at = found.index(best)
            tokens[at : at + 2] = [best & LOW]
            del found[at]
            if at < len(found):
                found[at] = known(tokens[at] << SHIFT | tokens[at + 1], NONE)
            if at:
                found[at - 1] = known(tokens[at - 1] << SHIFT | tokens[at], NONE)
        return tokens

    def _merge_long(self, tokens: list[int]) -> list[int]:
        """The same with a queue of merges and linked tokens."""
        known, tokens, end = self._known.get, list(tokens), len(tokens)
        after, before = list(range(1, end + 1)), list(range(-1, end - 1))
        queue = [(f, i) for i in range(end - 1) if (f := known(tokens[i] << SHIFT | tokens[i + 1], NONE)) < NONE]
        heapq.heapify(queue)
        while queue:
            best, i = heapq.heappop(queue)
            j = after[i]
            # Skip what an earlier merge has changed.
            if tokens[i] < 0 or j == end or known(tokens[i] << SHIFT | tokens[j], NONE) != best:
                continue
            tokens[i], tokens[j], after[i] = best & LOW, -1, after[j]
            for a, b in ((before[i], i), (i, after[j])):
                if a >= 0 and b < end:
                    before[b] = a
                    if (f := known(tokens[a] << SHIFT | tokens[b], NONE)) < NONE:
                        heapq.heappush(queue, (f, a))
        return [t for t in tokens if t >= 0]


class Stream:
    """One word of any length, byte by byte; holds a window and the lookahead at most."""

    def __init__(self, merger: Merger) -> None:
        self._merger, self._held = merger, b""

    def feed(self, data: bytes, last: bool = False) -> list[int]:
        """The tokens that are final now."""
        merger, found, at = self._merger, [], 0
        room = merger.lookahead + WINDOW
        while True:
            take = room - len(self._held)
            self._held += data[at : at + take]
            at += take
            if at >= len(data) and last:
                break
            if len(self._held) < room:
                return found
            # The last byte held may be the word's last one, which is another token.
            tokens = merger.merge([merger.inner[b] for b in self._held[:-1]])
            done, end = 0, 0
            for token in tokens:
                if end + merger.lengths[token] > room - 1 - merger.lookahead:
                    break
                end += merger.lengths[token]
                done += 1
            found += tokens[:done]
            self._held = self._held[end:]
        held, self._held = self._held, b""
        if held:
            found += merger.merge([*(merger.inner[b] for b in held[:-1]), merger.final[held[-1]]])
        return found


@lru_cache(maxsize=1)
def _joining() -> frozenset[str]:
    """Characters that may join or move before what stands left of them in a normal form."""
    marks, seconds = set(), set()
    for code in range(0x300, 0x110000):
        c = chr(code)
        if unicodedata.combining(c):
            marks.add(c)
        parts = unicodedata.decomposition(c).split()
        if len(parts) == 2 and parts[0][0] != "<":
            seconds.add(chr(int(parts[1], 16)))
    jamo = {chr(code) for code in (*range(0x1161, 0x1176), *range(0x11A8, 0x11C3))}
    return frozenset(marks | seconds | jamo)


class Rules:
    """How a vocabulary file normalises texts and cuts them into words."""

    def __init__(self, told: dict) -> None:
        steps = [s["type"] for s in (told["normalizer"] or {}).get("normalizers", [])]
        cut, letters = told["pre_tokenizer"]["pretokenizers"]
        if steps != ["NFC", "Replace", "Lowercase"] or told["normalizer"]["normalizers"][1]["pattern"] != {"Regex": r"\s+"}:
            raise ValueError(f"these steps of a normaliser are not known: {steps}")
        if (cut["type"], cut["behavior"], cut["invert"], letters["type"], letters["use_regex"]) != ("Split", "Removed", True, "ByteLevel", False):
            raise ValueError("only words found by a pattern, in byte letters, are known")
        if letters["add_prefix_space"] or any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in told["added_tokens"]):
            raise ValueError("spaces around words or special tokens are not known")
        self.pattern = cut["pattern"]["Regex"]
        # Runs of a class are open to both sides; the other alternatives have few characters.
        parts = self.pattern.split("|")
        self.runs = [p for p in parts if p.startswith("[") and p.endswith("]+")]
        self.longest = max(len(p) for p in parts if "[" not in p)
        from tokenizers import Tokenizer

        self._normalise = Tokenizer.from_str(json.dumps(told | {"model": {"type": "BPE", "vocab": {}, "merges": []}, "added_tokens": []})).normalizer.normalize_str
        self._compiled = lru_cache(maxsize=256)(self._with_unknown)

    def normal(self, text: str) -> str:
        """The normal form; white space, which no word holds, may differ from a space."""
        if text.isascii():
            return text.lower()
        if max(text) < SETTLED:
            text = unicodedata.normalize("NFC", text)
            # The case of a sigma does not depend on its place here.
            return text.lower() if "Σ" not in text else "".join(map(str.lower, text))
        return self._normalise(text)

    def _with_unknown(self, source: str, unknown: str) -> regex.Pattern:
        """A pattern in which characters that this Python's tables have no name for are in
        the classes in which the library's pattern engine has them."""
        if unknown:
            from tokenizers import Regex
            from tokenizers.pre_tokenizers import Split

            listed = "".join(f"\\U{ord(c):08x}" for c in unknown)

            def settled(match) -> str:
                engine = Split(Regex(match[0]), "removed", invert=True)
                held = "".join(f"\\U{ord(c):08x}" for c in unknown if engine.pre_tokenize_str(c))
                rest = f"[{match[0]}--[{listed}]]"
                return f"[{rest}||[{held}]]" if held else rest

            source = regex.sub(r"\[[^\]]*\]", settled, source)
        return regex.compile(source, regex.V1)

    def compiled(self, text: str, source: str | None = None) -> regex.Pattern:
        unknown = ""
        if not text.isascii() and max(text) >= SETTLED:
            unknown = "".join(sorted(c for c in set(text) if unicodedata.category(c) == "Cn"))
        return self._compiled(source or self.pattern, unknown)


def _chunks(text: str, start: int, end: int, size: int) -> Iterator[tuple[str, bool]]:
    """Parts of a text, and whether a word may go on in the next one."""
    joining = None
    while end - start > size:
        space = max(text.rfind(" ", start + 1, start + size), text.rfind("\n", start + 1, start + size))
        if space > 0:
            yield text[start:space], False
            start = space
            continue
        joining = joining or _joining()
        at = start + size
        while at < end and text[at] in joining:
            at += 1
        yield text[start:at], at < end
        start = at
    yield text[start:end], False


class Encoder:
    """Texts to token ids."""

    def __init__(self, file_text: str, chunk: int = CHUNK) -> None:
        told = json.loads(file_text)
        model = told["model"]
        if model["type"] != "BPE" or model.get("continuing_subword_prefix") or model.get("dropout") or model.get("ignore_merges"):
            raise ValueError("only plain byte-pair models are known")
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.merger = Merger(model["vocab"], merges, model.get("end_of_word_suffix") or "")
        self.rules = Rules(told)
        self.special = {t["content"]: t["id"] for t in told["added_tokens"]}
        self._special = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) or r"(?!)")
        self._words = _Words(self.merger)
        self._chunk = chunk

    def stream(self, text: str | None) -> Iterator[list[int]]:
        """The ids of a text, a chunk at a time."""
        text, start = text or "", 0
        for found in self._special.finditer(text):
            yield from self._plain(text, start, found.start())
            yield [self.special[found[0]]]
            start = found.end()
        yield from self._plain(text, start, len(text))

    def ids(self, text: str | None) -> list[int]:
        return list(chain.from_iterable(self.stream(text)))

    def _plain(self, text: str, start: int, end: int) -> Iterator[list[int]]:
        rules, words = self.rules, self._words
        held, run, stream = "", None, None
        for part, open_end in _chunks(text, start, end, self._chunk):
            part = held + rules.normal(part)
            if not open_end and stream is None:
                yield [*chain.from_iterable(map(words.__getitem__, rules.compiled(part).findall(part)))]
                held = ""
                continue
            found, held, at = [], "", 0
            if stream is not None:
                # A word that began before: all that its class holds.
                more = rules.compiled(part, run).match(part)
                at = more.end() if more else 0
                going = open_end and at == len(part)
                found += stream.feed(part[:at].encode(), last=not going)
                if going:
                    yield found
                    continue
                stream = None
            for match in rules.compiled(part).finditer(part, at):
                if open_end and match.start() > len(part) - rules.longest:
                    held = part[match.start() :]
                    break
                run = next((r for r in rules.runs if match.end() == len(part) and rules.compiled(part, r).fullmatch(match[0])), None)
                if open_end and run:
                    stream = Stream(self.merger)
                    found += stream.feed(match[0].encode())
                else:
                    found += words[match[0]]
            yield found


class _Words(dict):
    """Ids of words, filled as they are asked for."""

    def __init__(self, merger: Merger) -> None:
        super().__init__()
        self._merger = merger

    def __missing__(self, word: str) -> list[int]:
        if len(word) > LONGEST_REMEMBERED:
            return Stream(self._merger).feed(word.encode(), last=True)
        data, merger = word.encode(), self._merger
        found = merger.merge([*(merger.inner[b] for b in data[:-1]), merger.final[data[-1]]])
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = found
        return found


class Decoder:
    """Token ids to text.

    A file without a decoder shows tokens as they are listed, a space between any two;
    ``plain`` gives the words themselves, each followed by a space.
    """

    def __init__(self, file_text: str, plain: bool = False) -> None:
        told = json.loads(file_text)
        vocab = told["model"]["vocab"] | {t["content"]: t["id"] for t in told["added_tokens"]}
        self._between = b"" if plain else b" "
        if plain:
            suffix = told["model"].get("end_of_word_suffix") or ""
            by_letter = {c: b for b, c in enumerate(byte_letters())}

            def raw(token: str) -> bytes:
                ends = bool(suffix) and token.endswith(suffix)
                return bytes(by_letter[c] for c in (token[: -len(suffix)] if ends else token)) + b" " * ends

            special = {t["content"] for t in told["added_tokens"]}
            self._bytes = {i: t.encode() if t in special else raw(t) for t, i in vocab.items()}
        elif told["decoder"] is None:
            self._bytes = {i: t.encode() for t, i in vocab.items()}
        else:
            raise ValueError(f"this decoder is not known: {told['decoder']['type']}")
        self.start()

    def start(self) -> Decoder:
        """Forget what was fed; the next token is a text's first."""
        self._first = True
        self._text = codecs.getincrementaldecoder("utf-8")(errors="replace")
        return self

    def feed(self, ids: Iterable[int], last: bool = False) -> str:
        """The text that is complete now. Ids that the vocabulary lacks say nothing."""
        known = self._bytes
        parts = [known[i] for i in ids if i in known]
        data = self._between.join(parts)
        if parts and not self._first:
            data = self._between + data
        self._first = self._first and not parts
        return self._text.decode(data, last)


def read_vocabulary(path: str = VOCABULARY) -> str:
    with open(path, encoding="utf-8") as file:
        return file.read()


@lru_cache(maxsize=2)
def _coders(file_text: str) -> tuple[Encoder, Decoder, Decoder]:
    """Kept by a Python worker from task to task."""
    return Encoder(file_text), Decoder(file_text), Decoder(file_text, plain=True)


def _by_row(rows: DataFrame, vocabulary: str, schema: str, work: Callable) -> DataFrame:
    """Rows of (doc_id, value) through ``work``, which gets the coders and a value."""
    shared = rows.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))
    types = [pa.field(n, t) for n, t in work.columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coders = _coders(shared.value)
        for batch in batches:
            done = [work(coders, value.as_py()) for value in batch.column(1)]
            columns = list(zip(*done, strict=True)) or [()] * len(types)
            arrays = [pa.array(c, f.type) for c, f in zip(columns, types, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=["doc_id", *(f.name for f in types)])

    return rows.mapInArrow(run, schema)


def encode_documents(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id and ids of every whole text."""

    def work(coders, text):
        return (coders[0].ids(text),)

    work.columns = [("ids", pa.list_(pa.int32()))]
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return _by_row(rows, vocabulary, "doc_id long, ids array<int>", work)


def decode_documents(encoded: DataFrame, vocabulary: str = VOCABULARY, plain: bool = False) -> DataFrame:
    """doc_id and text of rows of ids (see ``Decoder``)."""

    def work(coders, ids):
        return (coders[1 + plain].start().feed(ids or (), last=True),)

    work.columns = [("text", pa.string())]
    rows = encoded.select(F.col("doc_id").cast("long"), F.col("ids").cast("array<int>"))
    return _by_row(rows, vocabulary, "doc_id long, text string", work)


def coding_report(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of the text decoded from them, all taken
    chunk by chunk."""

    def work(coders, text):
        encoder, decoder = coders[0], coders[1].start()
        count, ids_told, text_told = 0, hashlib.sha256(), hashlib.sha256()
        for ids in encoder.stream(text):
            if ids:
                ids_told.update(((" " if count else "") + " ".join(map(str, ids))).encode())
                text_told.update(decoder.feed(ids).encode())
                count += len(ids)
        text_told.update(decoder.feed((), last=True).encode())
        return count, ids_told.hexdigest(), text_told.hexdigest()

    work.columns = [("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return _by_row(rows, vocabulary, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", work)
