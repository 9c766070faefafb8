"""URL filter: glob rules as one bit-parallel wildcard automaton.

Every rule is a glob over the canonical form ``.host?path`` (``*`` any run,
``_`` never special; ``?`` is the boundary between host and path, which neither
side can hold).  All rules are packed into the bits of a few 64-bit words.  One
step of the automaton reads one byte of every URL of a batch at once:

    D = ((D << 1) & B[byte]) | (D & L)

where B has the positions that accept a byte and L those followed by ``*``.
Shifts carry from word to word; a rule matches if its last bit is set at the
end.  A host rule ``example.net/en/`` is the glob ``*.example.net?/en/*``.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_CELLS = 8 << 20  # bytes of URLs simulated at once


class GlobAutomaton:
    """Packed Shift-And masks of glob patterns over bytes."""

    def __init__(self, globs: Sequence[str]):
        bits = sum(len(g.encode().replace(b"*", b"")) + 1 for g in globs)
        self.words = max(1, -(-bits // 64))
        self.accept = np.zeros((256, self.words), dtype=np.uint64)
        self.loop = np.zeros(self.words, dtype=np.uint64)
        self.start = np.zeros(self.words, dtype=np.uint64)
        self.last: list[int] = []
        at = 0
        for glob in globs:
            self._set(self.start, at)
            for byte in glob.encode():
                if byte == 0x2A:
                    self._set(self.loop, at)
                else:
                    at += 1
                    self._set(self.accept[byte], at)
            self.last.append(at)
            at += 1

    @staticmethod
    def _set(mask: np.ndarray, bit: int) -> None:
        mask[bit // 64] |= np.uint64(1 << (bit % 64))

    def step(self, state: np.ndarray, byte: np.ndarray) -> np.ndarray:
        moved = state << np.uint64(1)
        moved[:, 1:] |= state[:, :-1] >> np.uint64(63)
        return (moved & self.accept[byte]) | (state & self.loop)

    def match(self, texts: Sequence[bytes]) -> np.ndarray:
        """Boolean matrix: does glob j match the whole of text i."""
        out = np.zeros((len(texts), len(self.last)), dtype=bool)
        order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
        begin = 0
        while begin < len(order):
            widest = max(1, len(texts[order[begin]]))
            some = order[begin : begin + max(1, BLOCK_CELLS // widest)]
            begin += len(some)
            lengths = np.array([len(texts[i]) for i in some])
            offsets = np.concatenate([[0], np.cumsum(lengths)[:-1]])
            flat = np.frombuffer(b"".join(texts[i] for i in some), dtype=np.uint8)
            state = np.repeat(self.start[None, :], len(some), axis=0)
            alive = len(some)  # the texts are sorted by falling length
            for at in range(widest):
                while alive and lengths[alive - 1] <= at:
                    alive -= 1
                if not alive:
                    break
                state[:alive] = self.step(state[:alive], flat[offsets[:alive] + at])
            for j, bit in enumerate(self.last):
                out[some, j] = (state[:, bit // 64] >> np.uint64(bit % 64)) & np.uint64(1) == 1
        return out


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path of a URL; both empty without ``://``."""
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    ends = [i for i in map(rest.find, "?#") if i >= 0]
    rest = rest[: min(ends)] if ends else rest
    host, slash, path = rest.partition("/")
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), slash + path


def _verdicts(host_rules: Sequence[tuple[str, str]], globs: Sequence[tuple[str, str]], default: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = GlobAutomaton([f"*.{h}?{p}*" for h, p in ((r.partition("/")[0], "/" + r.partition("/")[2]) for r, _ in host_rules)] + [g for g, _ in globs])
        # longest host rule first, block before allow among equals; then the longest glob
        ranked = sorted(range(len(host_rules)), key=lambda j: (-len(host_rules[j][0]), host_rules[j][1] != "block", host_rules[j][0]))
        softly = sorted(range(len(globs)), key=lambda j: (-len(globs[j][0]), globs[j][1] != "block", globs[j][0]))
        for batch in batches:
            hosts, paths = [], []
            for url in batch.column("url").to_pylist():
                h, p = split_url(url)
                hosts.append(h)
                paths.append(p)
            hits = automaton.match([f".{h}?{p}".encode() for h, p in zip(hosts, paths, strict=True)])
            rules, verdicts, methods = [None] * len(hosts), [default] * len(hosts), [None] * len(hosts)
            for j in reversed(softly):
                for i in np.flatnonzero(hits[:, len(host_rules) + j]).tolist():
                    verdicts[i], methods[i] = globs[j][1], globs[j][0]
            for j in reversed(ranked):
                for i in np.flatnonzero(hits[:, j]).tolist():
                    rules[i], verdicts[i] = host_rules[j]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), *(pa.array(x, pa.string()) for x in (hosts, paths, rules, verdicts, methods))],
                names=["page_id", "host", "path", "rule", "verdict", "glob"],
            )

    return run


def url_filter(pages: DataFrame, host_rules: Sequence[tuple[str, str]], globs: Sequence[tuple[str, str]], default: str = "allow", page_id: str = "page_id", url: str = "url") -> DataFrame:
    """Judge every URL: (page_id, host, path, rule, verdict, glob).

    ``host_rules`` are (host/path prefix, 'block' or 'allow'): a rule fits its
    host and all subdomains if the URL's path starts with the rule's; the longest
    wins.  Where none fits, the longest matching glob over ``.host?path`` decides,
    else ``default``.  ``rule`` and ``glob`` are null where nothing matched.

    A null URL, or one without ``://``, has an empty host and path, fits no host
    rule and is judged by the globs.  Rows are judged one by one, so repeated
    rows repeat and an empty table gives an empty result; other columns are not read.
    """
    for name, _ in host_rules:
        if "/" not in name or set("*?#") & set(name):
            raise ValueError(f"not a host rule: {name}")
    kind = dict(pages.dtypes)[page_id]
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"))
    return rows.mapInArrow(_verdicts(list(host_rules), list(globs), default), f"page_id {kind}, host string, path string, rule string, verdict string, glob string")
