"""Plain versions of the operators, for small inputs."""

import hashlib
import math
import re
from collections import defaultdict

KINDS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def luhn(digits):
    return sum(d if i % 2 == 0 else 2 * d - 9 * (2 * d > 9) for i, d in enumerate(map(int, digits[::-1]))) % 10 == 0


def holds(kind, value):
    digits = re.sub("[^0-9]", "", value)
    return kind == "email" or kind == "ip" and all(int(p) <= 255 for p in value.split(".")) or kind == "card" and 16 <= len(digits) <= 19 and luhn(digits) or kind == "phone" and 8 <= len(digits) <= 15


def base_spans(text):
    return [(k, m.start(), m.end()) for k, p in KINDS.items() for m in re.finditer(p, text or "") if holds(k, m.group())]


def _words(text):
    return re.findall(r"\w+", text.lower())


def disclosing(rows, discloses, support):
    """Terms that carry enough of an e-mail address, by sets of documents; for ASCII texts with whole contexts (each of one mention)."""
    texts = sorted(set(rows))
    holds, contexts, joint = defaultdict(set), defaultdict(set), defaultdict(set)
    for doc in texts:
        for m in re.finditer(KINDS["email"], doc[1]):
            entity, around = m.group().lower(), (doc[1][max(0, m.start() - 160) : m.start()], doc[1][m.end() : m.end() + 160])
            holds[entity].add(doc)
            for term in set(_words(" ".join(around))):
                contexts[entity, term].add(around)
                joint[entity, term].add(doc)
    n, out = len(texts), set()
    for (entity, term), where in joint.items():
        if len(contexts[entity, term]) >= support and len(holds[entity]) < n:
            df = sum(term in _words(doc[1]) for doc in texts)
            if math.log(n * len(where) / (len(holds[entity]) * df)) / math.log(n / len(holds[entity])) >= discloses:
                out.add(term)
    return out


def term_spans(text, terms):
    base = base_spans(text)
    return [(m.start(), m.end()) for m in re.finditer(r"\w+", text) if m.group().lower() in terms and not any(a < m.end() and m.start() < b for _, a, b in base)]


def line_dedup(rows):
    """doc_id -> (n_lines, n_dropped, kept)."""
    key = lambda line: line.strip(" \t\n\v\f\r").translate(LOWER)
    holders = defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n"):
            holders[key(line)].add(i)
    out = {}
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [line for line in lines if not (len(key(line)) >= 20 and len(holders[key(line)]) >= 3 and max(holders[key(line)]) != i)]
        out[i] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    return out


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset(tuple(words[j : j + 5]) for j in range(len(words) - 4)) if len(words) >= 5 else frozenset([tuple(words)] if words else [])


def near(rows):
    """doc_id -> (n_shingles, component_id)."""
    sets = {i: shingles(t) for i, t in rows}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if sets[a] and 100 * both >= 85 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: (len(sets[i]), root(i)) for i in ids}


def windows(words, size=13):
    n = min(size, len(words))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if words else set()


def decontaminate(rows, items):
    """doc_id -> (n_words, n_hit, items, contaminated)."""
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    table = {i: windows(words(t)) for i, t in items if t is not None}
    out = {}
    for doc, text in rows:
        found, hit, names = words(text), set(), set()
        for item, grams in table.items():
            for gram in grams:
                for i in range(len(found) - len(gram) + 1):
                    if tuple(found[i : i + len(gram)]) == gram:
                        hit |= set(range(i, i + len(gram)))
                        names.add(item)
        out[doc] = (len(found), len(hit), ",".join(sorted(map(str, names))), bool(hit) and 20 * len(hit) >= len(found))
    return out
