"""Token counts by prefix dynamic programming.

For a BPE vocabulary with a mark at word ends, the tokens of a word's prefixes follow from each other: let last(i) be
the last token of the first i symbols without the mark. Then last(i) is the one token t that ends there for which
last(i - |t|), t is a pair that merging would leave apart, and count(i) = count(i - |t|) + 1; with the mark at its
end, likewise. Which pairs stay apart is found by merging the pair alone, once for each pair. So the counts at
every prefix of a word cost one pass over it, and the counts at every prefix of a text are sums over its words.

``Counter.profiles`` gives the ends of a text's words (each with the blank before it) and the count up to each;
``at_prefix`` and ``cut`` answer how many tokens any prefix has, and which is the longest within a budget, from these and
one word's pass: nothing is encoded again. ``Scan`` is that pass for any text, character by character: it normalises, parts
words as the file's pattern does and steps the table, so each prefix costs the same whatever the text holds (white space of all
kinds, apostrophes, decomposed letters, special tokens' strings, no blank at all).

All counts are those of the library without added begin, end or special tokens.

Nulls, empties, repeats: a null or empty text has no tokens; rows repeat as they are; null ids are kept; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import itertools
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common, vocab

LIMIT = 2048


class WordTable:
    """Counts at the prefixes of words, for BPE with ``end_of_word_suffix``."""

    #: Words of more symbols aren't kept.
    KEPT = 64

    def __init__(self, file: str):
        model = json.load(open(file))["model"]
        self.vocab = model["vocab"]
        self.mark = model.get("end_of_word_suffix") or ""
        self.rank = {tuple(m.split(" ") if isinstance(m, str) else m): k for k, m in enumerate(model["merges"])}
        self.longest = max(map(len, self.vocab))
        marked = [t.removesuffix(self.mark) for t in self.vocab if self.mark and t.endswith(self.mark)]
        plain = [t for t in self.vocab if not (self.mark and t.endswith(self.mark))]
        #: For tokens with the mark (left out here) and without: whether an end of a token is a token itself.
        self.tails = {mark: {t[k:]: False for t in tokens for k in range(len(t))} | dict.fromkeys(tokens, True) for mark, tokens in ((self.mark, marked or plain), ("", plain))}
        self.apart = vocab.Memo(self._apart)
        self._counts = vocab.Memo(self._count)

    def merge(self, symbols: list[str]) -> list[str]:
        """Plain BPE: the best-ranked pair, leftmost first, till none is left."""
        while len(symbols) > 1:
            best = min(range(len(symbols) - 1), key=lambda k: (self.rank.get((symbols[k], symbols[k + 1]), 1 << 60), k))
            if (symbols[best], symbols[best + 1]) not in self.rank:
                break
            symbols[best : best + 2] = [symbols[best] + symbols[best + 1]]
        return symbols

    def _symbols(self, token: str) -> list[str]:
        if self.mark and token.endswith(self.mark):
            plain = token[: -len(self.mark)]
            return [*plain[:-1], plain[-1] + self.mark] if plain else [self.mark]
        return list(token)

    def _apart(self, pair: tuple[str | None, str]) -> bool:
        """Whether merging leaves the two tokens (or the one) as they are."""
        a, b = pair
        return self.merge((self._symbols(a) if a else []) + self._symbols(b)) == ([a, b] if a else [b])

    def _count(self, word: str) -> int:
        """Tokens of a whole word: as ``Word`` has them, in one loop."""
        n, apart, mark = len(word), self.apart, self.mark
        last, counts, tails = [None] * (n + 1), [0] * (n + 1), self.tails[""]
        for end in range(1, n + 1):
            if end == n:
                tails = self.tails[mark]
            for start in range(end - 1, -1, -1):
                own = word[start:end]
                is_token = tails.get(own)
                if is_token is None:
                    break
                if is_token and (start == 0 or last[start] is not None):
                    if end == n:
                        own += mark
                    if apart[last[start], own]:
                        last[end], counts[end] = own, counts[start] + 1
                        break
        return counts[n]

    def count(self, word: str) -> int:
        return self._counts[word] if len(word) <= self.KEPT else self._count(word)


class Word:
    """A word that grows symbol by symbol: the last token, and the number of tokens, without the mark at each place."""

    def __init__(self, table: WordTable):
        self.table, self.last, self.counts, self.tail = table, [None], [0], ""

    def _token(self, tail: str, n: int, mark: str) -> tuple[str | None, int]:
        """The one token that can end at place ``n``."""
        tails, last = self.table.tails[mark], self.last
        for k in range(1, len(tail) + 1):
            own = tail[-k:]
            is_token = tails.get(own)
            if is_token is None:
                break
            if is_token and (k == n or last[n - k] is not None) and self.table.apart[last[n - k], own + mark]:
                return own + mark, self.counts[n - k] + 1
        return None, 0

    def push(self, symbols: str) -> None:
        for symbol in symbols:
            self.tail = (self.tail + symbol)[-self.table.longest :]
            token, n = self._token(self.tail, len(self.counts), "")
            self.last.append(token)
            self.counts.append(n)

    def count(self) -> int:
        """Tokens if the word ends here."""
        n = len(self.counts) - 1
        return self._token(self.tail, n, self.table.mark)[1] if n else 0

    def cut(self, n: int, tail: str) -> None:
        del self.last[n:], self.counts[n:]
        self.tail = tail


#: Fixed values of the vocabulary's pattern: white space, and the endings that an apostrophe starts.
SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
ENDINGS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")


class Scan:
    """The tokens of what was read so far of a text without special tokens: character by character in lower case and NFC."""

    _BLANK = re.compile(f"[{SPACE}]")
    _STARTS = {e[:k] for e in ENDINGS for k in range(1, len(e))}

    def __init__(self, counter: Counter):
        self.counter, self.done, self.word, self.kind, self.quote, self.before = counter, 0, None, "", "", 0

    def tokens(self) -> int:
        return self.done + (self.word.count() if self.word else 0)

    def least(self) -> int:
        """Tokens that there will be at least, however the text goes on."""
        return self.done + ((len(self.word.counts) - 1) // self.counter.words.longest if self.word else 0)

    def _close(self) -> None:
        self.done, self.word, self.kind = self.tokens(), None, ""

    def put(self, c: str) -> None:
        kind = " " if self._BLANK.match(c) else unicodedata.category(c)[0]
        kind = kind if kind in " LN" else "*"
        quote = self.quote and self.quote + c
        if quote in ENDINGS:
            self.done, self.word, self.kind, self.quote = self.before + self.counter.words.count(quote), None, "", ""
            return
        self.quote = quote if quote in self._STARTS else ""
        if kind != self.kind or kind == "N":
            self._close()
            if kind == " ":
                return
            if c == "'":
                self.quote, self.before = c, self.done
            self.word, self.kind = Word(self.counter.words), kind
        self.word.push(self.counter.symbols(c))

    def state(self) -> tuple:
        return self.done, self.word, self.kind, self.quote, self.before, *((len(self.word.counts), self.word.tail) if self.word else (0, ""))

    def restore(self, state: tuple) -> None:
        self.done, self.word, self.kind, self.quote, self.before, n, tail = state
        if self.word:
            self.word.cut(n, tail)

    def read(self, text: str) -> Iterator[int]:
        """The tokens after each character of ``text``. A letter with its marks is one: it is read anew with each mark."""
        start = 0
        for at in range(1, len(text) + 1):
            if at < len(text) and self._joins(text[at]):
                continue
            own = text[start:at]
            for k in range(1, len(own) + 1):
                state = self.state() if k < len(own) else None
                for c in unicodedata.normalize("NFC", own[:k]) if not own.isascii() else own:
                    for low in c.lower():
                        self.put(low)
                yield self.tokens()
                if state:
                    self.restore(state)
            start = at

    @staticmethod
    def _joins(c: str) -> bool:
        """Whether normal forms may join ``c`` with what stands before it."""
        return c > "\u02ff" and (unicodedata.category(c)[0] == "M" or "\u1160" <= c <= "\u11ff" or "\ud7b0" <= c <= "\ud7ff")


class Counter(vocab.SpanEncoder):
    WORDS = 2_000_000
    CHUNK = re.compile(f"[^{SPACE}]*[{SPACE}]+|[^{SPACE}]+")
    LETTERS = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+[.,]?")
    BLANKS = re.compile(f"[{SPACE}]+")

    def __init__(self, file: str):
        super().__init__(np.dtype("<u4"))
        self.tok = vocab.tokenizer(file)
        self.words = WordTable(file)
        specials = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, sorted(specials, key=len, reverse=True))) or r"(?!)")
        #: Byte-level vocabularies write a byte that isn't visible as the next character from 256 on.
        seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.visible = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in seen)}

    def symbols(self, text: str) -> str:
        if text.isascii() and text.isprintable() and " " not in text:
            return text
        return text.encode().decode("latin-1").translate(self.visible)

    def library(self, text: str) -> int:
        return len(self.tok.encode(text, add_special_tokens=False).ids)

    def odd(self, b: np.ndarray, blank: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
        """Blanks have no tokens, however many there are."""
        return []

    def learn(self, words: list[str]) -> list[np.ndarray]:
        return list(np.array([self._chunk(w[1:] if w[0] in " \n" else w) if not self.BLANKS.search(w, 1) else self.count(w) for w in words], self.dtype)[:, None])

    def count(self, text: str) -> int:
        return sum(map(self._chunk, self.BLANKS.split(text)))

    def _chunk(self, chunk: str) -> int:
        """Tokens of a text without white space."""
        if self.LETTERS.fullmatch(chunk):  # one word and at most one stop; their normal form is the lower case
            word = chunk.rstrip(".,")
            count = self.words.count(self.symbols(word.lower()))
            return count + self.words.count(chunk[-1]) if len(word) < len(chunk) else count
        if not chunk:
            return 0
        if self.special.search(chunk):
            parts = self.special.split(chunk)
            return len(parts) - 1 + sum(map(self._chunk, parts))
        text = self.tok.normalizer.normalize_str(chunk) if self.tok.normalizer else chunk
        return sum(self.words.count(w) for w, _ in self.tok.pre_tokenizer.pre_tokenize_str(text))

    def profiles(self, texts: list[str]) -> list[tuple[str, np.ndarray, np.ndarray]]:
        """Of each text: itself, where its words end (in code points), and the tokens up to there."""
        own = self.spans_of([t.encode() for t in texts])
        points = np.r_[0, np.cumsum((own.b & 0xC0) != 0x80)]
        tokens = self.ids.gather(own.entry)[0].astype(np.int64)
        stops, out, before, begin = np.searchsorted(own.start, own.ends).tolist(), [], 0, 0
        for k, (text, stop) in enumerate(zip(texts, stops)):
            if own.whole[k]:
                chunks = self.CHUNK.findall(text)
                ends = np.fromiter(map(len, chunks), np.int64, len(chunks)).cumsum()
                counts = np.fromiter(map(self.count, chunks), np.int64, len(chunks)).cumsum()
            else:
                ends, counts = points[own.end[before:stop]] - points[begin], tokens[before:stop].cumsum()
            out.append((text, ends, counts))
            before, begin = stop, int(own.ends[k])
        return out

    def profile(self, text: str) -> tuple[str, np.ndarray, np.ndarray]:
        return self.profiles([text])[0]

    def prefixes(self, text: str) -> Iterator[tuple[int, int]]:
        """For each character: tokens up to and with it, and tokens that no later character changes."""
        before, at = 0, 0
        for m in [*self.special.finditer(text), None]:
            scan, begin = Scan(self), before
            n = (m.end() - 1 if m else len(text)) - at
            counts = [before]
            for tokens in scan.read(text[at : at + n]):
                counts.append(before + tokens)
                yield counts[-1], begin
                if not scan.quote and (not m or len(counts) <= m.start() - at):
                    begin = before + scan.least()
            if m:  # the special token is one, and what is before it ends there
                before, at = counts[m.start() - at] + 1, m.end()
                yield before, before

    def at_prefix(self, profile: tuple, n: int) -> int:
        """Tokens of the first ``n`` code points of the text."""
        text, ends, counts = profile
        k = int(np.searchsorted(ends, n, "right"))
        before, start = (int(counts[k - 1]), int(ends[k - 1])) if k else (0, 0)
        if k == len(ends) or n <= start:
            return before
        return before + next(itertools.islice(self.prefixes(text[start : int(ends[k])]), n - start - 1, None))[0]

    def cut(self, profile: tuple, budget: int) -> int:
        """Code points of the longest prefix with at most ``budget`` tokens."""
        text, ends, counts = profile
        k = int(np.searchsorted(counts, budget, "right"))
        best = int(ends[k - 1]) if k else 0
        if k < len(ends):
            before = int(counts[k - 1]) if k else 0
            for at, (tokens, least) in enumerate(self.prefixes(text[best : int(ends[k])]), best + 1):
                if before + tokens <= budget:
                    best = at
                if before + least > budget:
                    break
        return best


@lru_cache(maxsize=2)
def counter(file: str) -> Counter:
    return Counter(file)


def _emit(file: str, limit: int, table: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(file)
        for batch in common.slices(batches, most=1 << 20):
            rows, tables = [], []
            for doc_id, found in zip(common.column(batch, "doc_id"), own.profiles(common.column(batch, "text"))):
                text, ends, counts = found
                n = int(counts[-1]) if len(counts) else 0
                rows.append((doc_id, len(text.encode()), len(text), n, n > limit, own.cut(found, limit)))
                if table:
                    tables.append((ends, counts))
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64())
            cols = [pa.array(c, t) for c, t in zip(zip(*rows), types)]
            cols += [pa.array(c, pa.list_(pa.int64())) for c in zip(*tables)]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_bytes", "n_chars", "n_tokens", "over_limit", "cut_chars", *["ends", "counts"] * table])

    return run


COLUMNS = "doc_id long, n_bytes long, n_chars long, n_tokens long, over_limit boolean, cut_chars long"


def count(docs: DataFrame, file: str, limit: int = LIMIT, table: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts of each text, whether it has over ``limit`` tokens, and the code points of its longest prefix within ``limit``; ``table`` adds the chunks' ends and counts."""
    return common.id_text(docs, id_col=id_col, text_col=text_col).mapInArrow(_emit(file, limit, table), COLUMNS + ", ends array<long>, counts array<long>" * table)
