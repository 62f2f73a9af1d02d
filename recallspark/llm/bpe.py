"""Byte-pair encoding by dynamic programming over prefixes, and decoding.

A prefix of a word has one encoding, so it has one last token. A suffix automaton of all tokens reads the word and gives, for each prefix, the tokens that
end there. One of them is the last token of the prefix if the rest of the prefix ends with a token that is compatible with it: two tokens
are compatible if no merge across their border comes before the merges that made them. The last tokens are stored for all prefixes, and back-pointers
from the end give the ids. Merges are never replayed.

Words are cut and normalised as the vocabulary's file says, by the tokenizers library. ASCII white space ends a word whatever comes before or after it,
so a stretch between white space is encoded once a task and kept.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, short_batches, text_bytes

#: Stretches and pairs of tokens that a process keeps, some 250 MB; when there are more, all go.
KEPT_STRETCHES, KEPT_PAIRS = 1 << 20, 1 << 19
#: Bytes of the longest stretch that is kept.
KEPT_BYTES = 64
#: A token that no merge makes dies never.
NEVER = 1 << 60


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if it can be printed, else one from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class SuffixAutomaton:
    """All substrings of some sequences over a small alphabet, in flat arrays.

    Each state is a class of substrings with the same ends; link leads to that of their longest suffix that is in another class. ends has the
    sequences that are whole members of a state, longest first.
    """

    def __init__(self, sequences: list[list[int]]):
        step, link, size = [{}], [-1], [0]
        for s in sequences:
            last = 0
            for c in s:
                last = self._extend(step, link, size, last, c)
        members = [[] for _ in step]
        for i, s in enumerate(sequences):
            state = 0  # the state of an earlier sequence may have been split since
            for c in s:
                state = step[state][c]
            members[state].append(i)
        self.first, self.symbol, self.next = array("i", [0]), array("H"), array("i")
        for t in step:
            for c in sorted(t):
                self.symbol.append(c)
                self.next.append(t[c])
            self.first.append(len(self.symbol))
        self.link, self.size = array("i", link), array("i", size)
        self.at, self.ends = array("i", [0]), array("i")
        for m in members:
            self.ends.extend(sorted(m, key=lambda i: -len(sequences[i])))
            self.at.append(len(self.ends))

    @staticmethod
    def _extend(step: list[dict], link: list[int], size: list[int], last: int, c: int) -> int:
        def split(p: int, q: int) -> int:
            """The state of q's members that are suffixes of p's longest and c."""
            if size[p] + 1 == size[q]:
                return q
            copy = len(step)
            step.append(dict(step[q]))
            link.append(link[q])
            size.append(size[p] + 1)
            link[q] = copy
            while p != -1 and step[p].get(c) == q:
                step[p][c] = copy
                p = link[p]
            return copy

        if c in step[last]:
            return split(last, step[last][c])
        new = len(step)
        step.append({})
        link.append(0)
        size.append(size[last] + 1)
        p = last
        while p != -1 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p != -1:
            link[new] = split(p, step[p][c])
        return new


class Vocabulary:
    """A byte-level vocabulary with word ends, of the tokenizers library's JSON; pickled to tasks, some 20 MB for 49,408 tokens.

    Symbols are bytes, and bytes that end a word (from 256 on). Merges must be in the order of their making: a part comes before the whole, and each token is made by one merge.
    """

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        plain = ("dropout", "continuing_subword_prefix", "byte_fallback", "fuse_unk", "ignore_merges")
        if model["type"] != "BPE" or any(model.get(k) for k in plain) or spec.get("decoder") or spec.get("post_processor"):
            raise ValueError(f"{path}: only plain byte-pair encodings without decoder and post-processor can be read")
        end, vocab = model.get("end_of_word_suffix") or "", model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        if any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec.get("added_tokens", [])):
            raise ValueError(f"{path}: added tokens must be literal")
        letters = byte_letters()
        byte = {x: b for b, x in enumerate(letters)}
        self.text = [""] * (1 + max([*vocab.values(), *self.special.values()]))
        for t, i in [*vocab.items(), *self.special.items()]:
            self.text[i] = t
        n = len(self.text)
        self.left, self.right, self.dies = (array("i", [-1]) * n for _ in range(3))
        self.pairs = {}
        base = {i: [byte[x[0]] + (256 if x[1:] else 0)] for x, i in ((t, vocab.get(t)) for b in letters for t in {b, b + end}) if i is not None}
        symbols = dict(base)
        for rank, merge in enumerate(model["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            whole, a, b = vocab[a + b], vocab[a], vocab[b]
            if a not in symbols or b not in symbols or whole in symbols:
                raise ValueError(f"{path}: merge {rank} is out of order")
            self.left[whole], self.right[whole], self.dies[whole] = a, b, rank
            self.pairs[a * n + b] = rank
            symbols[whole] = symbols[a] + symbols[b]
        if len(base) < 256 * (2 if end else 1) or any(symbols[i] == [] for i in symbols):
            raise ValueError(f"{path}: a byte has no token")
        self.word_end = 256 if end else 0
        # A token whose own parts are not compatible is never the encoding of its bytes.
        whole = [i for i in sorted(symbols) if self.left[i] < 0 or self._makes(i)]
        self.ids, self.length = array("i", whole), array("i", [len(symbols[i]) for i in whole])
        self.automaton = SuffixAutomaton([symbols[i] for i in whole])
        self.cutter = json.dumps(spec | {"added_tokens": [], "truncation": None, "padding": None, "model": {"type": "BPE", "vocab": {}, "merges": []}})

    def _makes(self, i: int) -> bool:
        """Whether the token's bytes are encoded as the token: its parts are joined by its own merge before any other across their border."""
        return self._border(self.left[i], self.right[i], self.dies[i])

    def _border(self, a: int, b: int, before: int) -> bool:
        """Whether no merge across the border of two tokens comes before the merges within them, and before the given rank."""
        n, pairs, left, right, dies = len(self.text), self.pairs, self.left, self.right, self.dies
        x, until_x = a, NEVER
        while x >= 0:
            y, until_y = b, NEVER
            while y >= 0:
                rank = pairs.get(x * n + y)
                # Of equal merges the leftmost comes first: x would be taken from the left before, y from the right after.
                if rank is not None and rank < before and rank < until_x and rank <= until_y:
                    return False
                y, until_y = left[y], dies[y]
            x, until_x = right[x], dies[x]
        return True

    def ready(self) -> None:
        """What a task looks up symbol by symbol: steps by state and symbol, and for each state the tokens that end there with their lengths, longest first."""
        auto, ids, length = self.automaton, self.ids, self.length
        self.steps = {v << 9 | auto.symbol[i]: auto.next[i] for v in range(len(auto.size)) for i in range(auto.first[v], auto.first[v + 1])}
        self.tokens: list[tuple] = [()] * len(auto.size)
        for v in sorted(range(1, len(auto.size)), key=auto.size.__getitem__):
            own = [(ids[auto.ends[k]], length[auto.ends[k]]) for k in range(auto.at[v], auto.at[v + 1])]
            self.tokens[v] = (*own, *self.tokens[auto.link[v]]) if own else self.tokens[auto.link[v]]
        self.compatible: dict[int, bool] = {}
        self.many = len(self.text)

    def encode(self, words: list[bytes]) -> Iterator[list[int]]:
        """Ids of each word's tokens. Prefixes that a word shares with the one before are not looked at again: sorted words come fastest.

        The time is linear in the words, but for tokens that are suffixes of each other.
        """
        states, reads, last, back = [0], [0], [0], [0]  # for each prefix that ends no word; of its last token, the id and the length
        before, step, end = b"", self._next, self.word_end
        for word in words:
            if not word:
                yield []
                continue
            n, same = len(word) - 1, 0
            most = min(n, len(before) - 1)
            while same < most and word[same] == before[same]:
                same += 1
            del states[same + 1 :], reads[same + 1 :], last[same + 1 :], back[same + 1 :]
            state, read = states[same], reads[same]
            for i in range(same, n):
                state, read, token, size = step(state, read, word[i], i + 1, last)
                states.append(state)
                reads.append(read)
                last.append(token)
                back.append(size)
            _, _, token, size = step(state, read, word[n] + end, n + 1, last)
            out, i = [token], n + 1 - size
            while i:
                out.append(last[i])
                i -= back[i]
            out.reverse()
            before = word
            yield out

    def _next(self, state: int, read: int, c: int, i: int, last: list[int]) -> tuple[int, int, int, int]:
        """The automaton's state and matched length after symbol c, and id and length of the last token of the prefix of i symbols."""
        to = self.steps.get(state << 9 | c)
        while to is None:  # every symbol is a token, so the start has a step
            state = self.automaton.link[state]
            read = self.automaton.size[state]
            to = self.steps.get(state << 9 | c)
        read += 1
        compatible = self.compatible
        for t, n in self.tokens[to]:
            if n > read:
                continue
            if n == i:
                return to, read, t, n
            if n < i:
                pair = last[i - n] * self.many + t
                fits = compatible.get(pair)
                if fits is None:
                    if len(compatible) >= KEPT_PAIRS:
                        compatible.clear()
                    fits = compatible[pair] = self._border(last[i - n], t, NEVER)
                if fits:
                    return to, read, t, n
        raise ValueError(f"no token ends the first {i} symbols of a word")


class Encoder:
    """Encodes texts by a Vocabulary. Stretches between white space are encoded once, sorted by their words, and kept."""

    def __init__(self, vocabulary: Vocabulary):
        from tokenizers import Tokenizer

        cutter = Tokenizer.from_str(vocabulary.cutter)
        vocabulary.ready()
        self.vocabulary, self.normalizer, self.cut = vocabulary, cutter.normalizer, cutter.pre_tokenizer
        self.byte = {ord(x): chr(b) for b, x in enumerate(byte_letters())}
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(vocabulary.special, key=len, reverse=True))) + ")") if vocabulary.special else None
        self.names = [str(i) for i in range(len(vocabulary.text))]
        self.texts = dict(zip(self.names, vocabulary.text, strict=True))
        self.kept: dict[bytes, str] = {}

    def _words(self, stretch: bytes) -> list[str]:
        """The words of a stretch, in byte letters, and special tokens as `special:id`; malformed UTF-8 counts as U+FFFD."""
        text, out = stretch.decode("utf-8", "replace"), []
        for part in self.special.split(text) if self.special else [text]:
            if part in self.vocabulary.special:
                out.append(f"special:{self.vocabulary.special[part]}")
            elif part:
                out += [w for w, _ in self.cut.pre_tokenize_str(self.normalizer.normalize_str(part) if self.normalizer else part)]
        return out

    def _cuts(self, stretches: set[bytes]) -> dict[bytes, list[str]]:
        """The words of each stretch. Those of printable ASCII are cut in one call, with a space between them, as no rule sees beyond white space."""
        plain = [x for x in stretches if x.isascii() and x.decode().isprintable()]
        text = b" ".join(plain).decode()
        if self.special and self.special.search(text):
            plain = [x for x in plain if not self.special.search(x.decode())]
            text = b" ".join(plain).decode()
        out: dict[bytes, list[str]] = {x: [] for x in plain}
        even = self.normalizer.normalize_str(text) if self.normalizer else text
        if len(even) != len(text):
            out, plain, even = {}, [], ""
        i, end, into = -1, 0, []
        for word, (start, _) in self.cut.pre_tokenize_str(even):
            while start >= end:
                i += 1
                end += len(plain[i]) + 1
                into = out[plain[i]]
            into.append(word)
        for x in stretches:
            if x not in out:
                out[x] = self._words(x)
        return out

    def learn(self, stretches: set[bytes]) -> None:
        """Encodes these stretches and keeps their ids."""
        cuts = self._cuts(stretches)
        words = {w for c in cuts.values() for w in c}
        plain = sorted(w.translate(self.byte).encode("latin-1") for w in words if not w.startswith("special:"))
        letters = byte_letters()
        names, ids = self.names, {f"special:{i}": self.names[i] for i in self.vocabulary.special.values()}
        for w, found in zip(plain, self.vocabulary.encode(plain), strict=True):
            ids["".join([letters[b] for b in w])] = " ".join([names[i] for i in found])
        for x, c in cuts.items():
            self.kept[x] = " ".join([ids[w] for w in c])

    def encode(self, texts: list[bytes]) -> list[str]:
        """The ids of each text, in decimal and joined by a space."""
        cut = [x.split() for x in texts]
        if len(self.kept) > KEPT_STRETCHES:
            self.kept.clear()
        new = set().union(*cut).difference(self.kept)
        self.learn(new)
        out = [" ".join(filter(None, map(self.kept.__getitem__, x))) for x in cut]
        for x in new:
            if len(x) > KEPT_BYTES:
                del self.kept[x]
        return out

    def decode(self, ids: str) -> str:
        """The tokens of ids as encode() writes them, joined by a space, as a vocabulary without decoder is decoded."""
        return " ".join(map(self.texts.__getitem__, ids.split(" "))) if ids else ""


def encode(docs: DataFrame, path: str) -> DataFrame:
    """docs (doc_id, text) -> doc_id, ids (array of int), decoded, for every row.

    Null texts count as empty and have no ids. Malformed UTF-8 counts as U+FFFD. Rows with the same doc_id each have a row; other columns are not read.
    """

    def row(ids: str, decoded: str) -> tuple:
        return [int(i) for i in ids.split()], decoded

    return _mapped(docs, path, row, [("ids", pa.list_(pa.int32())), ("decoded", pa.string())], "ids array<int>, decoded string")


def digest(docs: DataFrame, path: str) -> DataFrame:
    """The same, as numbers and hashes: doc_id, n_tokens, ids_sha256 (of decimal ids joined by a space), decoded_sha256."""

    def row(ids: str, decoded: str) -> tuple:
        return ids.count(" ") + 1 if ids else 0, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()

    return _mapped(docs, path, row, [("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())], "n_tokens long, ids_sha256 string, decoded_sha256 string")


def _mapped(docs: DataFrame, path: str, row, fields: list[tuple], kind: str) -> DataFrame:
    # Read on the driver: executors need not have the file. Its size is the vocabulary's, whatever the corpus.
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary(path))
    schema = pa.schema([("doc_id", pa.int64()), *fields])

    def run(batches):
        vocabulary = shared.value
        if not hasattr(vocabulary, "encoder"):  # kept for the tasks that the process runs later
            vocabulary.encoder = Encoder(vocabulary)
        encoder = vocabulary.encoder
        for b in batches:
            for i, j in chunks(b.column(1)):
                found = encoder.encode(b.column(1).slice(i, j - i).to_pylist())
                columns = zip(*[row(x, encoder.decode(x)) for x in found], strict=True)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), *(pa.array(x, f.type) for x, f in zip(columns, list(schema)[1:], strict=True))], schema=schema)

    short = short_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("body"))
    return short.mapInArrow(run, f"doc_id long, {kind}")
