"""A double-array trie of vocabulary pieces, walked for many words at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

MARK = "▁"
#: Longer words are cut where no piece can span the cut, and parts that are
#: still longer are walked one by one.
LONG = 128


def load_pieces(path: str) -> tuple[list[str], np.ndarray, dict[str, int]]:
    """Pieces of a SentencePiece file that stand for text, by id ('' for the
    others); log scores by id; and ids of bytes. The file's own order is by
    falling frequency, so the log score follows Zipf's law on that rank."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    bytes_ = {model.id_to_piece(i): i for i in range(n) if model.is_byte(i)}
    plain = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
    scores = np.full(n, -np.inf)
    scores[plain] = -np.log(np.arange(1, len(plain) + 1)) - np.log(np.sum(1 / np.arange(1, len(plain) + 1)))
    text = [""] * n
    for i in plain:
        text[i] = model.id_to_piece(i)
    return text, scores, bytes_


class Trie:
    """``base[state] + code`` is the next state, if its ``check`` is the state."""

    def __init__(self, pieces: list[str], longest: int | None = None):
        chars: dict[str, int] = {}
        for p in pieces:
            for c in p:
                chars[c] = chars.get(c, 0) + 1
        self.codes = {c: k + 1 for k, c in enumerate(sorted(chars, key=lambda c: (-chars[c], c)))}
        table = np.zeros(0x110000, np.int32)
        for c, k in self.codes.items():
            table[ord(c)] = k
        self.code_of = table
        kept = [(p, i) for i, p in enumerate(pieces) if p and (longest is None or len(p) <= longest)]
        self.longest = max((len(p) for p, _ in kept), default=0)
        root: dict = {}
        for p, i in kept:
            node = root
            for c in p:
                node = node.setdefault(self.codes[c], {})
            node[0] = i
        self._place(root)
        pairs = {(self.codes[a], self.codes[b]) for p, _ in kept for a, b in zip(p, p[1:])}
        self.pairs = np.sort(np.array([a << 32 | b for a, b in pairs], np.int64))

    def _place(self, root: dict) -> None:
        """Breadth first; a node's children go to the lowest base at which
        all their cells are free."""
        size = 1 << 18
        base, check, value = [np.full(size, -1, np.int32) for _ in range(3)]
        taken = np.zeros(size, bool)
        taken[0] = True
        queue, lowest, span = [(root, 0)], 1, 1 << 11
        for node, state in queue:
            value[state] = node.get(0, -1)
            codes = np.array(sorted(k for k in node if k), np.int64)
            if not len(codes):
                continue
            lowest += int(np.argmin(taken[lowest:]))
            begin = max(lowest, int(codes[0]) + 1)
            while True:
                while begin + span + int(codes[-1]) + 1 >= size:
                    base, check, value = [np.concatenate((x, np.full(size, -1, np.int32))) for x in (base, check, value)]
                    taken = np.concatenate((taken, np.zeros(size, bool)))
                    size *= 2
                free = begin + np.flatnonzero(~taken[begin : begin + span]) - codes[0]
                fits = free[~taken[free[:, None] + codes].any(1)] if len(codes) > 1 else free
                if len(fits):
                    b = int(fits[0])
                    break
                begin += span
            base[state] = b
            taken[b + codes] = True
            check[b + codes] = state
            queue.extend((node[int(c)], b + int(c)) for c in codes)
        self.base, self.check, self.value = base, check, value

    def matrix(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Codes of words, a row each, 0 for characters of no piece and after
        the end; and lengths."""
        length = np.fromiter(map(len, words), np.int64, len(words))
        flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        codes = np.zeros((len(words), int(length.max(initial=0))), np.int32)
        codes[np.arange(codes.shape[1]) < length[:, None]] = self.code_of[flat]
        return codes, length

    def parts(self, words: list[str]) -> tuple[list[tuple[int, int]], np.ndarray]:
        """Begin and end of the parts of words, and the words they are of. A
        cut stands between two characters that no piece has side by side, so every
        segmentation of the word has it too."""
        out: list[tuple[int, int]] = []
        of: list[np.ndarray] = []
        for i, word in enumerate(words):
            ends = [len(word)]
            if len(word) > LONG:
                codes = self.matrix([word])[0][0].astype(np.int64)
                pairs = codes[:-1] << 32 | codes[1:]
                at = np.minimum(np.searchsorted(self.pairs, pairs), max(0, len(self.pairs) - 1))
                ends = [*(np.flatnonzero(self.pairs[at] != pairs) + 1).tolist(), len(word)] if len(self.pairs) else [*range(1, len(word) + 1)]
            out += zip([0, *ends[:-1]], ends, strict=True)
            of.append(np.full(len(ends), i))
        return out, np.concatenate(of) if of else np.zeros(0, np.int64)

    def edges(self, word: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All pieces in a long word, by begin and length: begins, ends, ids; -1
        for a character that is no piece by itself."""
        codes = np.concatenate((self.matrix([word])[0][0], np.zeros(self.longest, np.int32)))
        rows, state = np.arange(len(word)), np.zeros(len(word), np.int32)
        single = np.full(len(word), -1)
        found = []
        for k in range(1, self.longest + 1):
            code = codes[rows + k - 1]
            into = np.minimum(self.base[state] + code, len(self.check) - 1)
            alive = (code > 0) & (self.base[state] >= 0) & (self.check[into] == state)
            rows, state = rows[alive], into[alive]
            piece = self.value[state]
            some = piece >= 0
            if k == 1:
                single[rows[some]] = piece[some]
                found.append((np.arange(len(word)), 1, single))
            else:
                found.append((rows[some], k, piece[some]))
        begin, end, piece = np.concatenate([r for r, *_ in found]), np.concatenate([r + k for r, k, _ in found]), np.concatenate([x for *_, x in found])
        order = np.argsort(begin, kind="stable")
        return begin[order], end[order], piece[order]

    def matches(self, codes: np.ndarray, at: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Pieces that begin at character ``at``: lengths, with the rows and
        the pieces' ids."""
        rows = np.arange(len(codes))
        state = np.zeros(len(codes), np.int32)
        for k in range(1, min(self.longest, codes.shape[1] - at) + 1):
            code = codes[rows, at + k - 1]
            into = np.minimum(self.base[state] + code, len(self.check) - 1)
            alive = (code > 0) & (self.base[state] >= 0) & (self.check[into] == state)
            if not alive.any():
                return
            rows, state = rows[alive], into[alive]
            piece = self.value[state]
            some = piece >= 0
            if some.any():
                yield k, rows[some], piece[some]


def length_groups(lengths: np.ndarray, cells: int = 1 << 20) -> Iterator[np.ndarray]:
    """Row numbers in groups of like length; a group's matrix has at most
    ``cells`` entries, or one row."""
    order = np.argsort(lengths, kind="stable")
    begin = 0
    while begin < len(order):
        least = max(4, int(lengths[order[begin]]))
        end = int(np.searchsorted(lengths[order], least * 3 // 2, "right"))
        end = min(end, begin + max(1, cells // (least * 3 // 2)))
        yield order[begin:end]
        begin = max(end, begin + 1)
