"""The cache of pieces that the two tokenisation operators share."""

import random

import pyarrow as pa
import regex

from docketry.llm import bpe, token_files
from docketry.llm.pretokens import CachedEncoder


def test_cache_is_bounded_and_ids_are_those_of_the_matches():
    """What is kept grows neither with the different words nor with their matches, and does not show in the ids."""
    from public_tokenizers import PATTERN

    asked = []

    def encode(matches):
        asked.extend(matches)
        return [m.encode() + b"|" for m in matches]

    encoder = CachedEncoder(PATTERN, encode, entries=100)
    draw = random.Random(3)
    texts = [None, "", " ", "a  b", "a   b ", "\n a\n b", "it's  é"] + ["".join(draw.choice(" \n\tab1.'é中") for _ in range(30)) for _ in range(500)]
    for column in (pa.array(texts), pa.array(texts, pa.large_string()), texts):
        got = encoder.encode_many(column)
        assert got == [b"".join(m.encode() + b"|" for m in regex.findall(PATTERN, t or "")) for t in texts]
    for i in range(50):
        encoder.encode_many([f"w{'abcdefghij'[i % 10]}{i}x{j}" + " same." for j in range(40)])
    assert len(encoder.young) + len(encoder.old) < 2_000
    asked.clear()
    encoder.encode_many(["x same. same. same."])
    assert " same" not in asked


def test_library_gets_new_words_together():
    """The words that the cache lacks are few texts for the library, however many they are."""
    encoder = token_files.LibraryEncoder(token_files.tokenizer_path())
    calls, ids = [], encoder._ids
    encoder._ids = lambda texts: calls.extend(texts) or ids(texts)
    encoder.cached.encode_pieces = encoder._ids_of_pieces
    text = " ".join(f"w{i}.é" for i in range(5_000))
    (got,) = encoder.encode_many([text])
    assert got.tolist() == [*encoder.tokenizer.encode(text, add_special_tokens=False).ids, token_files.END_ID]
    assert len(calls) < 50


def _merged_one_by_one(ranks, piece):
    """A whole token, or merges: the lowest rank first, then the leftmost."""
    parts = [piece] if piece in ranks else [piece[i : i + 1] for i in range(len(piece))]
    while True:
        pairs = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
        if not pairs:
            return b"".join(ranks[p].to_bytes(4, "little") for p in parts)
        _, i = min(pairs)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


def test_matches_share_a_queue(monkeypatch):
    """New matches are merged together, with the ids of each alone, whatever ranks a merge brings."""
    for seed in range(60):
        draw = random.Random(seed)
        tokens = {b"a", b"b", b"c"} | {bytes(draw.choice(b"abc") for _ in range(draw.randint(2, 6))) for _ in range(40)}
        tokens = draw.sample(sorted(tokens), len(tokens))
        own = bpe.BytePairEncoding({t: i for i, t in enumerate(tokens)}, ".+")
        pieces = [bytes(draw.choice(b"abc") for _ in range(draw.randint(0, 40))) for _ in range(60)] + [b"a" * 99, b"ab" * 50]
        monkeypatch.setattr(bpe, "AT_ONCE", draw.choice((1, 24, 1 << 30)))
        monkeypatch.setattr(bpe, "QUEUED_BYTES", draw.choice((1, 300, 1 << 20)))
        assert own.encode_matches(pieces) == [_merged_one_by_one(own.ranks, p) for p in pieces]
    monkeypatch.undo()
    own, turns, lowest = bpe.loaded(*bpe.vocabulary_path()), [], bpe.RankQueue.lowest
    monkeypatch.setattr(bpe.RankQueue, "lowest", lambda queue: turns.append(1) or lowest(queue))
    draw = random.Random(7)
    pieces = [b" " + bytes(draw.choice(b"etaoinsr") for _ in range(12)) for _ in range(3_000)]
    assert own.encode_matches(pieces) == [_merged_one_by_one(own.ranks, p) for p in pieces]
    assert len(turns) < 3_000
