"""BPE encoding and decoding by a tokenization automaton.

The automaton reads tokens: it accepts exactly the token sequences that BPE produces. It starts as one
state with an arc for every base symbol, and every merge (a, b), in order of priority, adds a gadget:

* the state T(a) that arcs labelled a lead to is copied without its arc b, and those arcs now lead to
  the copy, so that a is no longer followed by b;
* every state with an arc a gets an arc ab, which leads where b leads.

All arcs of a label y lead to one state, which is named by y. It descends from the state that y's second
half had when y was made, and has since lost one arc by each merge (y, b). A gadget is therefore stored
as the pair and its time, and which arcs a state has follows from a short walk (``allows``) down the
second halves of its label and the first halves of the arc's label. Results of the walk are kept in the
transition table, which only holds arcs that texts use.
The automaton accepts one path for each pre-split word, and encoding finds it by following arcs, the longest
match first; an end from which no arc leads on is remembered as dead.
"""

from __future__ import annotations

import gc
import hashlib
import json
import sys
import unicodedata
from dataclasses import dataclass

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import documents, give_back, packed, share, unpacked, with_text_columns


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: printable
    Latin-1 stands for itself, the others follow from code point 256 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


START = -1


@dataclass
class Automaton:
    """Compiled merges. Labels are token ids; the state that a label's arcs lead to bears its id."""

    labels: list[str]                      # token id to its text in the vocabulary
    ids: dict[str, int]
    halves: list[tuple[int, int]]          # label to the labels it was merged from, (-1, -1) for a base symbol
    made: list[int]                        # label to the time of its merge, 0 for a base symbol
    gadgets: dict[tuple[int, int], int]    # (state's label, lost label) to the time of the loss
    end: str                               # suffix of a word's last symbol
    special: dict[str, int]


def compile_automaton(vocabulary: dict[str, int], merges: list[tuple[str, str]], *, end: str = "",
                      special: dict[str, int] | None = None) -> Automaton:
    size = max(vocabulary.values(), default=-1) + 1
    labels, halves, made, gadgets = [""] * size, [(-1, -1)] * size, [0] * size, {}
    for token, number in vocabulary.items():
        labels[number] = token
    for time, (a, b) in enumerate(merges, 1):
        first, second, joined = vocabulary[a], vocabulary[b], vocabulary[a + b]
        gadgets[first, second] = time
        halves[joined], made[joined] = (first, second), time
    return Automaton(labels, dict(vocabulary), halves, made, gadgets, end, special or {})


def load(path: str) -> tuple[dict[str, int], list[tuple[str, str]], str, dict[str, int]]:
    """Vocabulary, merges, word-end suffix and special tokens of a tokenizer file (JSON)."""
    with open(path, encoding="utf-8") as file:
        content = json.load(file)
    model = content["model"]
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    return model["vocab"], merges, model.get("end_of_word_suffix") or "", {t["content"]: t["id"] for t in content["added_tokens"]}


def letter_tree(ids: dict[str, int], end: str = "") -> dict[str, tuple[int, dict]]:
    """The entries of a vocabulary as nested dicts, letter by letter: the token that ends there, or -1, and what follows.
    Entries that bear the word end only match a word's last letters and are looked up whole: the tree holds their letters before
    the last, to tell where that may succeed."""
    root: dict[str, tuple[int, dict]] = {}
    for label, token in ids.items():
        node, last = root, len(label) - 1
        if end and label.endswith(end):
            label = label[:max(len(label) - len(end) - 1, 0)]
        for k, letter in enumerate(label):
            number, following = node.get(letter) or (-1, {})
            node[letter] = token if k == last else number, following
            node = following
    return root


class Recent(dict):
    """Values by key, None for others: of the keys used last, ``limit`` at most and at least half as many."""

    def __init__(self, limit: int):
        super().__init__()
        self.half, self.older = max(limit // 2, 1), {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is not None:
            self.put(key, value)
        return value

    def put(self, key, value) -> None:
        if len(self) >= self.half:
            self.older = dict(self)
            self.clear()
        self[key] = value


class Encoder:
    """Table-driven encoding with the arcs and words seen last.

    It is broadcast with empty tables. Tasks that reuse a Python worker reuse its tables; once the worker has other tasks, it
    gives their memory back."""

    settled = False

    def __init__(self, automaton: Automaton, limit: int = 150_000):
        self.a, self.limit = automaton, limit
        self.arcs: dict[tuple[int, int], bool] = {}
        self.words, self.chunks = Recent(limit), Recent(limit)
        self.pattern = None
        self.symbols = dict(enumerate(byte_symbols()))
        self.bytes_known = all(c in automaton.ids and c + automaton.end in automaton.ids for c in self.symbols.values())
        #: By character the token of what has been read and what may follow it in longer entries.
        self.reach = letter_tree(automaton.ids, automaton.end)

    def settle(self) -> None:
        """The vocabulary is not gone through again by every collection. Once per worker, after what earlier tasks left
        is collected: what is frozen is never freed as part of a cycle."""
        if not self.settled:
            gc.collect()
            gc.freeze()
            self.settled = True

    def __del__(self):
        if self.settled and not sys.is_finalizing():
            self.__dict__.clear()
            give_back()

    def special_tokens(self, text: str):
        if not any(token in text for token in self.a.special):
            return ()
        if self.pattern is None:
            self.pattern = regex.compile("|".join(map(regex.escape, sorted(self.a.special, key=len, reverse=True))))
        return self.pattern.finditer(text)

    def allows(self, state: int, label: int) -> bool:
        """Whether ``state`` has an arc ``label``. A state loses an arc by a gadget of its own label, or of
        a label it descends from while it did not exist yet; an arc that a merge made is there if the
        arc of its first half was there at that time."""
        found = self.arcs.get((state, label))
        if found is None:
            halves, made, gadgets = self.a.halves, self.a.made, self.a.gadgets
            found, x, until = True, label, len(gadgets) + 1
            while found and x >= 0 and state != START:
                y, before = state, len(gadgets) + 2
                while y >= 0:
                    time = gadgets.get((y, x))
                    if time is not None and time <= until and time < before:
                        found = False
                        break
                    before = min(before, made[y]) if made[y] else before
                    y = halves[y][1]
                until = min(until, made[x])
                x = halves[x][0]
            if len(self.arcs) >= 2 * self.limit:
                self.arcs.clear()
            self.arcs[state, label] = found
        return found

    def word(self, word: str) -> tuple[int, ...]:
        """Token ids of one pre-split word; a symbol that the vocabulary lacks is left out."""
        known = self.words[word]
        if known is not None:
            return known
        end, ids = self.a.end, self.a.ids
        # printable ASCII stands for itself
        text = word if word.isascii() and word.isprintable() and " " not in word else word.encode().decode("latin-1").translate(self.symbols)
        if not self.bytes_known:
            last = text[-1:] + end in ids
            text = "".join(c for c in text[:-1] if c in ids) + text[-1:] * last
            end = end if last else ""
        n = len(text)
        final = text + end
        arcs, reach = self.arcs, self.reach
        matches: dict[int, list[tuple[int, int]]] = {}   # start to (end, token), the longest last
        open_ends, path, dead = [], [], set()            # untried matches of each step; the path so far
        at, here = 0, START
        while at < n:
            ends = matches.get(at)
            if ends is None:
                ends, node = [], reach
                matches[at] = ends
                for j in range(at, n - 1):
                    found = node.get(text[j])
                    if found is None:
                        break
                    token, node = found
                    if token >= 0:
                        ends.append((j + 1, token))
                else:
                    token = ids.get(final[at:])
                    if token is not None:
                        ends.append((n, token))
            untried = len(ends)
            while True:
                while untried:
                    untried -= 1
                    step = ends[untried]
                    if dead and step in dead:
                        continue
                    arc = here, step[1]
                    found = arcs.get(arc)
                    if self.allows(*arc) if found is None else found:
                        break
                else:
                    dead.add((at, here))
                    if not path:
                        raise ValueError(f"no path for {word!r}")
                    path.pop()
                    untried = open_ends.pop()
                    at, here = path[-1] if path else (0, START)
                    ends = matches[at]
                    continue
                break
            open_ends.append(untried)
            path.append(step)
            at, here = step
        out = tuple([token for _, token in path])      # the garbage collector passes over tuples of numbers, not over lists
        self.words.put(word, out)
        return out


#: What ``str.split`` takes for white space, but ``SPLIT`` does not.
SEPARATORS = "\x1c\x1d\x1e\x1f"
LONG_CHUNK = 64               # characters of a chunk that is remembered
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def normalised(text: str) -> str:
    """NFC and lower case, code point by code point (a final sigma is like any other)."""
    if text.isascii():
        return text.lower()
    text = unicodedata.normalize("NFC", text)
    return text.lower() if text.isascii() else text.replace("Σ", "σ").lower()


def chunk_ids(text: str, encoder: Encoder, words) -> list[int]:
    """Token ids of a normalised text. No word reaches over white space, so the stretches between are encoded by themselves
    and remembered with all their words."""
    if any(c in text for c in SEPARATORS):
        return [token for word in words(text) for token in encoder.word(word)]
    ids, known = [], encoder.chunks
    for chunk in text.split():
        found = known[chunk]
        if found is None:
            parts = words(chunk)
            if parts == [chunk]:
                found = encoder.word(chunk)      # one word: both tables hold the same string and ids
            else:
                found = tuple([token for word in parts for token in encoder.word(word)])
            if len(chunk) <= LONG_CHUNK:
                known.put(chunk, found)
        ids += found
    return ids


def encode(text: str, encoder: Encoder, words) -> list[int]:
    """Token ids of a whole text. Special tokens are found in the raw text first."""
    ids, at = [], 0
    for match in encoder.special_tokens(text):
        ids += chunk_ids(normalised(text[at:match.start()]), encoder, words)
        ids.append(encoder.a.special[match.group()])
        at = match.end()
    return ids + chunk_ids(normalised(text[at:]), encoder, words)


def decoder(labels: list[str], special: dict[int, str]):
    """A function from ids to the arc labels of the ids, separated by spaces, as a vocabulary without a decoder gives
    them. Ids without a label are left out."""
    label_of = dict(enumerate(labels)) | special

    def whole(ids) -> str:
        try:
            return " ".join(map(label_of.__getitem__, ids))
        except KeyError:
            return " ".join(label_of[i] for i in ids if i in label_of)

    return whole


def decode(ids, labels: list[str], special: dict[int, str]) -> str:
    """``decoder`` for a single list of ids."""
    return decoder(labels, special)(ids)


def with_tokens(df: DataFrame, tokenizer: str, *, text_col: str = "text", texts_out: bool = True, digests: bool = False) -> DataFrame:
    """``df`` with ``token_ids`` (array<int>) and, if asked for, ``decoded`` and its ``decoded_sha256``. ``tokenizer`` is the path of a
    word-end BPE file; it is read once, on the driver, and the compiled automaton is broadcast (its size
    is the vocabulary's). Null and empty texts have no tokens and decode to the empty string."""
    shared = share(df.sparkSession, Encoder(compiled(tokenizer)))

    def make():
        encoder = shared.value
        encoder.settle()
        words = regex.compile(SPLIT).findall
        whole = decoder(encoder.a.labels, {number: token for token, number in encoder.a.special.items()})

        def columns(texts):
            ids = [encode(text or "", encoder, words) for text in texts]
            found = {"token_ids": ids}
            if texts_out or digests:
                found["decoded"] = [whole(i) for i in ids]
            if digests:
                found["decoded_sha256"] = [hashlib.sha256(text.encode()).hexdigest() for text in found["decoded"]]
            return found

        return columns

    return with_text_columns(
        df, make, "token_ids array<int>" + ", decoded string" * texts_out + ", decoded_sha256 string" * digests, text_col)


def compiled(tokenizer: str) -> Automaton:
    vocabulary, merges, end, special = load(tokenizer)
    return compile_automaton(vocabulary, merges, end=end, special=special)


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def digested(df: DataFrame, tokenizer: str, text_col: str = "text") -> DataFrame:
    """``df`` with the number of tokens and the digests of ids and decoded text."""
    shared = share(df.sparkSession, Encoder(compiled(tokenizer)))

    def make():
        encoder = shared.value
        encoder.settle()
        words = regex.compile(SPLIT).findall
        whole = decoder(encoder.a.labels, {number: token for token, number in encoder.a.special.items()})

        def columns(texts):
            rows = []
            for text in texts:
                ids = encode(text or "", encoder, words)
                rows.append((len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                             hashlib.sha256(whole(ids).encode()).hexdigest()))
            return {name: [r[i] for r in rows] for i, name in enumerate(("n_tokens", "ids_sha256", "decoded_sha256"))}

        return columns

    return with_text_columns(df, make, "n_tokens long, ids_sha256 string, decoded_sha256 string", text_col)


def query(spark, sf_dir):
    """op8: encode and decode every document."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return digested(docs, tokenizer_path()).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def encode_stage(spark, docs: DataFrame, sf_dir: str, *, digests: bool = False) -> DataFrame:
    """The columns of the documents with ``token_ids`` and ``n_tokens`` and, if asked for, ``decoded_sha256``,
    the digest of what the ids decode to. A text without tokens decodes to the empty string; no row is lost."""
    tokens = with_tokens(packed(docs), tokenizer_path(), texts_out=False, digests=digests)
    other, frame = F.col("other").withField("pl_token_ids", F.col("token_ids")), docs.withColumn("pl_token_ids", F.lit(None).cast("array<int>"))
    if digests:
        other, frame = other.withField("pl_decoded", F.col("decoded_sha256")), frame.withColumn("pl_decoded", F.lit(None).cast("string"))
    kept = unpacked(tokens.withColumn("other", other), frame)
    kept = kept.withColumnRenamed("pl_token_ids", "token_ids").withColumnRenamed("pl_decoded", "decoded_sha256")
    return kept.withColumn("n_tokens", F.size("token_ids").cast("long"))


def round_trip_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``encode_stage`` with every document's ids decoded again."""
    return encode_stage(spark, docs, sf_dir, digests=True)
