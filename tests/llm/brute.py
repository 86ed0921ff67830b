"""Plain versions of the operators for small fixtures."""

import hashlib
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(text: str | bytes) -> str:
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


def tokenizer(name: str):
    import public_tokenizers
    import tiktoken

    from surveyspark.llm.bpe import load_ranks

    return tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, special_tokens={},
                             mergeable_ranks=load_ranks(public_tokenizers.path(name)))


def without_repeats(rows, width=20):
    """{id: (words, removed, kept text)}; rows of one id are expected once."""
    seen, out = set(), {}
    for i, text in sorted(rows):
        words = WORD.findall(text or "")
        gone = [False] * len(words)
        for p in range(len(words) - width + 1):
            window = tuple(words[p:p + width])
            if window in seen:
                gone[p:p + width] = [True] * width
            seen.add(window)
        out[i] = (len(words), sum(gone), " ".join(w for w, g in zip(words, gone) if not g))
    return out


def shingles(text, width=5):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(words) < width:
        return {tuple(words)} if words else set()
    return {tuple(words[k:k + width]) for k in range(len(words) - width + 1)}


def roots(nodes, links):
    """{node: smallest node reachable}"""
    up = {n: n for n in nodes}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


def similar(rows):
    """{id: (set size, component)}"""
    sets = {i: shingles(t) for i, t in rows}
    ids = sorted(sets)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[:k]
             if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    component = roots(ids, links)
    return {i: (len(sets[i]), component[i]) for i in ids}
