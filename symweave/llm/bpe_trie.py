"""BPE encoding by a depth-first walk of a trie of distinct words.

The byte-pair encoding of a word has one last token for each prefix, and the encoding of a prefix is that of the
prefix without its last token, followed by this token.  The last token of a prefix is the one suffix token whose
seam with the token before it no merge would cross.  So distinct words are put in order and walked as a trie,
depth first: for each node (prefix) the last token is found once and shared by all words below it, and the path
from the root is all that is kept.  An Aho-Corasick automaton over the vocabulary lists the suffix tokens of a node.

Encodings of white-space-free chunks are memoised in each worker up to a bound; frequent ones stay, which changes no
result.

Text is put in normal form, lower-cased and split as the tokenizer file says.  The Unicode tables of Python and of the
tokenizers library differ, so chunks with letters beyond SETTLED are normalised and split by the library's own
normaliser and pre-tokenizer; their words go into the trie like all others.

Defined cases: a null or empty text has no tokens and decodes to the empty text; the two special tokens are matched
literally in the raw text, as the tokenizers library does by default.
"""

from __future__ import annotations

import hashlib
import json
from collections import deque
from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from tokenizers import Tokenizer

from symweave.llm.shared import slices

TOKENIZER = "word_bpe_49k.json"
MEMO = 160_000
FOREVER = 1 << 40
#: White space for str.split that is not white space for the tokenizer.
ODD_SPACE = regex.compile("[\x1c-\x1f]")
#: Code points whose normal form, case and class no version of Unicode has changed, and which no normal form joins to a neighbour: Latin,
#: Cyrillic, punctuation, kana, Han and Hangul syllables.  This matches what lies beyond.
UNSETTLED = regex.compile("[^\\u0000-\u02ff\u0400-\u0482\u048a-\u04ff\u2010-\u2027\u2030-\u203a\u20ac\u3001-\u3003\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3]")


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies: printable ones stand for themselves."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters, extra = {b: chr(b) for b in plain}, 256
    for b in range(256):
        if b not in letters:
            letters[b], extra = chr(extra), extra + 1
    return [letters[b] for b in range(256)]


class TrieBpe:
    """Encoder for a byte-level BPE tokenizer file with word ends."""

    def __init__(self, content: str):
        spec = json.loads(content)
        model = spec["model"]
        # The library's own normaliser and pre-tokenizer, without its model.
        library = Tokenizer.from_str(json.dumps(spec | {"model": model | {"vocab": {}, "merges": []}, "added_tokens": []}))
        self.normal, self.split = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        self.vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.name = {i: t for t, i in (self.vocab | self.special).items()}
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.pieces_of = regex.compile(pattern).findall
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")").split
        end = model["end_of_word_suffix"]
        letters = byte_letters()
        self.byte_of = {x: b for b, x in enumerate(letters)}
        self.inner = [self.vocab[x] for x in letters]
        self.final = [self.vocab[x + end] for x in letters]
        size = max(self.vocab.values()) + 1
        self.left, self.right, self.rank = [-1] * size, [-1] * size, [-1] * size
        self.merge: dict[int, int] = {}
        for r, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            whole = self.vocab[a + b]
            self.left[whole], self.right[whole], self.rank[whole] = self.vocab[a], self.vocab[b], r
            self.merge[self.vocab[a] << 20 | self.vocab[b]] = r
        self._automaton()
        self.seams: dict[int, bool] = {}
        self.ids: dict[str | int, str] = {}
        self.shown: dict[str | int, str] = {}
        self.word: dict[str, tuple[str, str]] = {}
        self.old_ids, self.old_shown, self.old_word = dict(self.ids), dict(self.shown), dict(self.word)

    def seam(self, a: int, b: int, below: int = FOREVER) -> bool:
        """Whether no merge of a rank under `below` joins the end of token a to the start of token b, going back through both tokens' merges."""
        rank, until_a, until_b = self.rank, below, below
        while True:
            r = self.merge.get(a << 20 | b)
            if r is not None and r < until_a and (r <= until_b if until_b != below else r < below):
                return False
            if rank[a] < 0 and rank[b] < 0:
                return True
            if rank[a] > rank[b]:
                until_a, a = rank[a], self.right[a]
            else:
                until_b, b = rank[b], self.left[b]

    def _automaton(self) -> None:
        """States over base symbols, with each state's suffix tokens, longest first."""
        symbols: dict[int, tuple[int, ...]] = {t: (t,) for t in (*self.inner, *self.final)}
        sound = dict.fromkeys(symbols, True)
        for t in sorted((t for t in range(len(self.rank)) if self.rank[t] >= 0), key=self.rank.__getitem__):
            a, b = self.left[t], self.right[t]
            symbols[t] = symbols[a] + symbols[b]
            sound[t] = sound[a] and sound[b] and self.seam(a, b, self.rank[t])
        self.length = [len(symbols.get(t, ())) for t in range(len(self.rank))]
        step: dict[int, int] = {}
        own: list[int] = [-1]
        for t, path in symbols.items():
            if sound[t]:
                state = 0
                for x in path:
                    key = state << 20 | x
                    state = step.get(key, -1)
                    if state < 0:
                        state = step[key] = len(own)
                        own.append(-1)
                own[state] = t
        self.step, self.fail = step, [0] * len(own)
        self.ends: list[tuple[int, ...]] = [()] * len(own)
        below: list[list[tuple[int, int]]] = [[] for _ in own]
        for key, state in step.items():
            below[key >> 20].append((key & 0xFFFFF, state))
        queue = deque([0])
        while queue:
            at = queue.popleft()
            for x, state in below[at]:
                back = self._next(self.fail[at], x) if at else 0
                self.fail[state] = back
                self.ends[state] = ((own[state],) if own[state] >= 0 else ()) + self.ends[back]
                queue.append(state)

    def _next(self, state: int, symbol: int) -> int:
        """The state after a symbol; ways over failure links are noted, so each is walked once."""
        step, at = self.step, state
        while True:
            to = step.get(at << 20 | symbol)
            if to is None and at:
                at = self.fail[at]
                continue
            to = to or 0
            if at != state:
                step[state << 20 | symbol] = to
            return to

    def encode_words(self, words: list[bytes]) -> Iterator[tuple[bytes, list[int]]]:
        """Token ids of distinct non-empty words, by one depth-first walk of their trie."""
        inner, final, length, ends, seams, step = self.inner, self.final, self.length, self.ends, self.seams, self.step
        states, last = [0], [-1]  # along the path from the root
        if len(seams) > MEMO:
            seams.clear()
        previous = b""
        for word in sorted(words):
            n, shared = len(word), 0
            most = min(n, len(previous)) - 1
            while shared < most and word[shared] == previous[shared]:
                shared += 1
            del states[shared + 1 :], last[shared + 1 :]
            state = states[shared]
            for depth in range(shared + 1, n + 1):
                # The node below by the next symbol: its automaton state and last token.  The word's last symbol ends it.
                symbol = inner[word[depth - 1]] if depth < n else final[word[-1]]
                to = step.get(state << 20 | symbol)
                state = self._next(state, symbol) if to is None else to
                for token in ends[state]:
                    before = depth - length[token]
                    if not before:
                        break
                    key = last[before] << 20 | token
                    fits = seams.get(key)
                    if fits is None:
                        fits = seams[key] = self.seam(last[before], token)
                    if fits:
                        break
                else:
                    raise ValueError("merges are not in order of creation")
                if depth < n:
                    states.append(state)
                    last.append(token)
            found, depth = [token], n - length[token]
            while depth:
                found.append(last[depth])
                depth -= length[last[depth]]
            found.reverse()
            yield word, found
            previous = word

    def _plain(self, text: str) -> list[str]:
        """Chunks without white space; lower case but for those that the library is to normalise."""
        settled = text.isascii() or not UNSETTLED.search(text)
        if settled:
            text = text.lower()
        cut = [c for c in regex.split(r"\s+", text) if c] if ODD_SPACE.search(text) else text.split()
        return cut if settled else [c if UNSETTLED.search(c) else c.lower() for c in cut]

    def pieces(self, chunk: str) -> list[str]:
        """The words of a chunk."""
        if chunk.isascii():
            if chunk.isalpha():
                return [chunk]
            if chunk[:-1].isalpha() and not chunk[-1].isalnum():
                return [chunk[:-1], chunk[-1]]
        elif UNSETTLED.search(chunk):
            return [bytes([self.byte_of[x] for x in shown]).decode() for shown, _ in self.split(self.normal(chunk))]
        return self.pieces_of(chunk)

    def chunks(self, text: str) -> list[str | int]:
        """Normalised chunks without white space; special tokens as their ids."""
        if "<|" in text:
            parts = self.split_special(text)
            if len(parts) > 1:
                return [x for i, part in enumerate(parts) for x in ([self.special[part]] if i % 2 else self._plain(part))]
        return self._plain(text)

    def learn(self, chunks: set[str | int]) -> None:
        """Puts the encodings of all these chunks in the memo.

        The memo has two generations: when the younger is full it becomes the older one, from which chunks come back as they occur
        again; so frequent chunks stay and rare ones go.
        """
        if len(self.ids) > MEMO // 2:
            self.old_ids, self.old_shown, self.ids, self.shown = self.ids, self.shown, {}, {}
        if len(self.word) > MEMO // 2:
            self.old_word, self.word = self.word, {}
        ids, shown, word = self.ids, self.shown, self.word
        new: list[tuple[str, list[str]]] = []
        words: set[str] = set()
        for c in chunks.difference(ids):
            known = self.old_ids.get(c)
            if known is not None:
                ids[c], shown[c] = known, self.old_shown[c]
            elif isinstance(c, int):
                ids[c], shown[c] = str(c), self.name[c]
            else:
                pieces = self.pieces(c)
                new.append((c, pieces))
                words.update(pieces)
        missing = []
        for w in words.difference(word):
            known = self.old_word.get(w)
            if known is None:
                missing.append(w)
            else:
                word[w] = known
        letters = {w.encode(): w for w in missing}
        name = self.name
        for code, found in self.encode_words(list(letters)):
            word[letters[code]] = " ".join(map(str, found)), " ".join([name[i] for i in found])
        for c, pieces in new:
            if len(pieces) == 1:
                ids[c], shown[c] = word[pieces[0]]
            else:
                both = [word[w] for w in pieces]
                ids[c] = " ".join([x[0] for x in both])
                shown[c] = " ".join([x[1] for x in both])

    def forget(self) -> None:
        """Empties the memo: workers live on after a task, and other stages need the memory."""
        for memo in (self.ids, self.shown, self.word, self.old_ids, self.old_shown, self.old_word, self.seams):
            memo.clear()
        pa.default_memory_pool().release_unused()

    def encode(self, text: str | None) -> list[int]:
        chunks = self.chunks(text or "")
        self.learn(set(chunks))
        return [int(i) for c in chunks for i in self.ids[c].split()]

    def decode(self, ids: list[int]) -> str:
        """The vocabulary's strings joined by spaces: this tokenizer file has no decoder."""
        return " ".join([self.name[i] for i in ids])


_loaded: dict[int, TrieBpe] = {}


def encoder(content: str) -> TrieBpe:
    """One encoder for each worker process and tokenizer file."""
    key = hash(content)
    if key not in _loaded:
        _loaded[key] = TrieBpe(content)
    return _loaded[key]


def _sent(spark: SparkSession, path: str | None) -> Broadcast:
    """The content of the tokenizer file (a few MB), which only the driver needs to hold."""
    with open(path or public_tokenizers.path(TOKENIZER), encoding="utf-8") as file:
        return spark.sparkContext.broadcast(file.read())


def digests(docs: DataFrame, path: str | None = None, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_tokens, and the SHA-256 of the ids joined by spaces and of the decoded text."""
    content = _sent(docs.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(content.value)
        sha = hashlib.sha256
        for whole in batches:
            for batch in slices(whole, "text"):
                cut = [bpe.chunks(t) if t else [] for t in batch.column(1).to_pylist()]
                bpe.learn(set().union(*cut))
                ids, shown = bpe.ids.__getitem__, bpe.shown.__getitem__
                counts, codes, texts = [], [], []
                for chunks in cut:
                    code = " ".join(map(ids, chunks))
                    counts.append(code.count(" ") + 1 if code else 0)
                    codes.append(sha(code.encode()).hexdigest())
                    texts.append(sha(" ".join(map(shown, chunks)).encode()).hexdigest())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(codes, pa.string()), pa.array(texts, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        bpe.forget()

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text")).mapInArrow(run, f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def encoded(docs: DataFrame, path: str | None = None, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, ids array<int> and the text decoded from them."""
    content = _sent(docs.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(content.value)
        for whole in batches:
            for batch in slices(whole, "text"):
                cut = [bpe.chunks(t) if t else [] for t in batch.column(1).to_pylist()]
                bpe.learn(set().union(*cut))
                ids = [[int(i) for c in chunks for i in bpe.ids[c].split()] for chunks in cut]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array([bpe.decode(x) for x in ids], pa.string())], ["doc_id", "ids", "decoded"])
        bpe.forget()

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text")).mapInArrow(run, f"doc_id {kind}, ids array<int>, decoded string")
