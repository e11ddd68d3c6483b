"""Plain versions of the operators, for small inputs."""

import hashlib
import re
from collections import defaultdict


def removed_bytes(texts, length=100):
    """texts: {key: text} by key. For each: bytes, flags of removed bytes."""
    seen, out = set(), {}
    for key in sorted(texts):
        data = (texts[key] or "").encode()
        gone = bytearray(len(data))
        for start in range(len(data) - length + 1):
            string = data[start:start + length]
            if string in seen:
                gone[start:start + length] = b"\1" * length
            seen.add(string)
        out[key] = data, gone
    return out


def repeats(texts, length=100):
    out = {}
    for key, (data, gone) in removed_bytes(texts, length).items():
        kept = bytes(b for b, g in zip(data, gone) if not g)
        runs = len(re.findall(rb"\x01+", bytes(gone)))
        out[key] = len(data), sum(gone), runs, hashlib.sha256(kept).hexdigest()
    return out


def lines_of(text):
    trimmed = [re.sub("[\t\r\f\v]", " ", line).strip(" ") for line in (text or "").split("\n")]
    return trimmed


def deleted_lines(texts, least=8):
    """{key: places among the lines that are not blank}: lines in a run of ``least`` words that
    stands earlier. A run is long enough if it holds a shortest window from either end."""
    seqs = {key: [line for line in lines_of(texts[key]) if line] for key in sorted(texts)}
    gone = defaultdict(set)
    for step in (1, -1):
        seen = set()
        for key, seq in seqs.items():
            for start in range(len(seq)):
                words, end = 0, start
                while 0 <= end < len(seq) and words < least:
                    words += len(re.split(" +", seq[end]))
                    end += step
                if words < least:
                    continue
                places = range(start, end, step)
                window = tuple(seq[i] for i in places)
                if window in seen:
                    gone[key].update(places)
                seen.add(window)
    return {key: gone[key] for key in texts}


def without_lines(text, gone):
    out, place = [], 0
    for raw, line in zip((text or "").split("\n"), lines_of(text)):
        if line and place in gone:
            place += 1
            continue
        place += bool(line)
        out.append(raw)
    return "\n".join(out)


def shingles(text, n=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i:i + n]) for i in range(max(1, len(words) - n + 1)))


def linked(a, b, percent=80):
    return bool(a) and bool(b) and 100 * len(a & b) >= percent * len(a | b)


def near_classes(texts):
    """{key: (size, smallest key reachable)}"""
    sets = {key: shingles(text) for key, text in texts.items()}
    label = {key: key for key in texts}
    changed = True
    while changed:
        changed = False
        for a in texts:
            for b in texts:
                if label[b] < label[a] and linked(sets[a], sets[b]):
                    label[a], changed = label[b], True
    return {key: (len(sets[key]), label[key]) for key in texts}
