"""URL filters (operator 9): a bit-parallel wildcard automaton.

All rules are globs over one canonical form of a URL, "." + host + path. They
are packed one after another into the bits of as many 64-bit words as needed
(Shift-And): bit i is on when the pattern's first i characters match what has
been read. `**` matches anything, `*` anything but a slash; both are loops at
the state before them. A whole Arrow batch of URLs advances together, one
character at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rippleframe.llm.wordbytes import LOWER, flat

#: (verdict, host, path) of the rules that the contract fixes.
HOST_RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
#: Globs that block a URL which no host rule fits.
BLOCK_GLOBS = ("*.spam-*/**", "*.*casino*/**", "*.*-pills.*/**", "*.*porn*/**", "*.*warez*/**", "*.ads.*/**", "**/wp-login*", "**/phishing/**")
CELLS = 1 << 22


@dataclass(frozen=True)
class Automaton:
    """Globs packed in bits: by byte the states it leads to and those it may loop in, the start and the accepting bits."""

    moves: np.ndarray
    loops: np.ndarray
    start: np.ndarray
    accept: tuple[tuple[int, np.uint64], ...]

    @staticmethod
    def of(globs: tuple[str, ...]) -> Automaton:
        parsed = []
        for glob in globs:
            states: list[list] = [[None, None]]  # of each state: the byte that leads to it, the loop at it
            for k, part in enumerate(glob.replace("**", "\0").encode().split(b"\0")):
                if k:
                    states[-1][1] = "any"
                for n, piece in enumerate(part.split(b"*")):
                    if n and states[-1][1] is None:
                        states[-1][1] = "segment"
                    states += [[byte, None] for byte in piece]
            parsed.append(states)
        words = max(1, -(-sum(map(len, parsed)) // 64))
        moves, loops, start, accept = np.zeros((256, words), np.uint64), np.zeros((256, words), np.uint64), np.zeros(words, np.uint64), []
        bit = 0
        for states in parsed:
            for n, (byte, loop) in enumerate(states):
                word, mask = bit // 64, np.uint64(1 << (bit % 64))
                if n:
                    moves[byte, word] |= mask
                else:
                    start[word] |= mask
                if loop:
                    loops[:, word] |= mask
                    if loop == "segment":
                        loops[ord("/"), word] &= ~mask
                bit += 1
            accept.append(((bit - 1) // 64, np.uint64(1 << ((bit - 1) % 64))))
        return Automaton(moves, loops, start, tuple(accept))

    def matches(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """(texts x globs) whether each glob matches the whole of each text of a flat byte array."""
        lengths = np.diff(offsets)
        order = np.argsort(-lengths, kind="stable")
        begins, left = offsets[:-1][order], lengths[order]
        state = np.tile(self.start, (len(order), 1))
        for at in range(int(left[0]) if len(left) else 0):
            live = int(np.searchsorted(-left, -at, side="left"))  # texts longer than at
            byte = data[begins[:live] + at]
            now = state[:live]
            shifted = now << np.uint64(1)
            shifted[:, 1:] |= now[:, :-1] >> np.uint64(63)
            state[:live] = (shifted & self.moves[byte]) | (now & self.loops[byte])
        out = np.zeros((len(order), len(self.accept)), bool)
        for k, (word, mask) in enumerate(self.accept):
            out[order, k] = (state[:, word] & mask) != 0
        return out


def canonical(url: F.Column) -> tuple[F.Column, F.Column]:
    """(host, path): between the first :// and the next / ? #, A-Z lower-cased; then up to ? or #. Empty without ://."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"\A[^/?#]*", 0)
    path = F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def filter_urls(df: DataFrame, id_col: str = "page_id", url_col: str = "url", host_rules=HOST_RULES, block_globs: tuple[str, ...] = BLOCK_GLOBS, default: str = "allow") -> DataFrame:
    """One row per input row: page_id, host, path, rule, verdict.

    A host rule fits its host and all subdomains where the path starts with the
    rule's; the longest rule (host and path) wins. Otherwise a URL that a block
    glob matches is blocked, any other gets `default`. A null URL or one without
    :// has empty host and path and the default. Repeated rows, null ids and very
    long URLs are judged like any other; other columns are ignored; an empty
    table gives an empty result. Globs see A-Z of the path lower-cased, host rules
    see the path as it is.
    """
    host, path = canonical(F.coalesce(F.col(f"`{url_col}`"), F.lit("")))
    rows = df.select(F.col(f"`{id_col}`").alias("page_id"), host.alias("host"), path.alias("path"))
    kind = rows.schema["page_id"].dataType.simpleString()
    rules = sorted(host_rules, key=lambda r: -len(r[1] + r[2]))
    exact = Automaton.of(tuple(f"*.{h}{p}**" for _, h, p in rules))
    loose = Automaton.of(tuple(block_globs))
    names = [h + p for _, h, p in rules] + [None]
    verdicts = [v for v, _, _ in rules]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (h, h_at), (p, p_at) = flat(batch.column(1)), flat(batch.column(2))
            n = batch.num_rows
            offsets = h_at + p_at + np.arange(n + 1)
            data = np.empty(int(offsets[-1]), np.uint8)
            data[offsets[:-1]] = ord(".")
            rows_of_h, rows_of_p = np.repeat(np.arange(n), np.diff(h_at)), np.repeat(np.arange(n), np.diff(p_at))
            data[np.arange(len(h)) + rows_of_h + 1 + p_at[:-1][rows_of_h]] = h
            data[np.arange(len(p)) + rows_of_p + 1 + h_at[1:][rows_of_p]] = p
            hit, blocked = exact.matches(data, offsets), loose.matches(LOWER[data], offsets).any(axis=1)
            best = np.where(hit.any(axis=1), hit.argmax(axis=1), len(rules))
            named = pa.array([names[k] for k in best], pa.string())
            said = pa.array([verdicts[k] if k < len(rules) else "block" if b else default for k, b in zip(best, blocked, strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], named, said], ["page_id", "host", "path", "rule", "verdict"])

    return rows.mapInArrow(run, f"page_id {kind}, host string, path string, rule string, verdict string")


#: The same verdicts as SQL over the view `pages`.
ORACLE = r"""
WITH r AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
     c AS (SELECT page_id, translate(regexp_extract(rest, '\A[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                  regexp_extract(rest, '\A[^/?#]*([^?#]*)', 1) AS path FROM r),
     t AS (SELECT *, '.' || host AS dotted, '.' || host || translate(path, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS whole FROM c),
     j AS (SELECT page_id, host, path, whole,
                  CASE WHEN suffix(dotted, '.example.org') AND prefix(path, '/en/1') THEN 'example.org/en/1'
                       WHEN suffix(dotted, '.example.org') AND prefix(path, '/es/') THEN 'example.org/es/'
                       WHEN suffix(dotted, '.com') AND prefix(path, '/fr/') THEN 'com/fr/'
                       WHEN suffix(dotted, '.com') AND prefix(path, '/de/') THEN 'com/de/'
                       WHEN suffix(dotted, '.org') AND prefix(path, '/') THEN 'org/' END AS rule FROM t)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
            WHEN regexp_full_match(whole, '[^/]*\.spam-[^/]*/.*|[^/]*\.[^/]*casino[^/]*/.*|[^/]*\.[^/]*-pills\.[^/]*/.*|[^/]*\.[^/]*porn[^/]*/.*|[^/]*\.[^/]*warez[^/]*/.*|[^/]*\.ads\.[^/]*/.*|.*/wp-login[^/]*|.*/phishing/.*', 's') THEN 'block'
            ELSE 'allow' END AS verdict
FROM j
"""
