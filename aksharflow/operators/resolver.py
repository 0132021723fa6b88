"""The lexicon-guided corrector token by token, in a worker: what lexicon.resolve() says, where all words are at hand."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable
from functools import cache

from ..functions import patterns as P

#: Tokens that a worker remembers at most.
MOST_WORDS = 100_000

_all = lambda patterns: tuple(re.compile(p) for p in patterns)
_any = lambda token, patterns: any(p.search(token) for p in patterns)
_COLLAPSE = [(re.compile(a), b) for a, b in ((P.DUP_HALANT, P.HALANT), (P.HALANT_DUP, P.HALANT + r"\1"), (P.REPEATED_CONSONANT, r"\1"), (P.DUP_MARKS, r"\1"), (P.DUP_MARK_CLUSTER, r"\1"))]
_LEADING_I, _J_SWAP, _NUKTA = re.compile(P.LEADING_I), re.compile(P.J_SWAP), re.compile(P.NONSTANDARD_NUKTA)
_CONSIDER, _NO_GUESS, _STRUCTURAL, _STRAY_I = map(_all, (P.CONSIDER, P.NO_GUESS, P.STRUCTURAL, P.STRAY_I))
#: Where this is not found, no collapsing applies.
_NOISY = re.compile(f"(.)\\1|([{P.VOWELS}][\u0901\u0902])\\2|[\u200c\u200d]|" + "|".join(a for a, _ in P.SIGN_SEQUENCES), re.S)
_SUSPICIOUS = re.compile(P.SUSPICIOUS_MARKS)
_UNCLEAN = _all((P.SPURIOUS_NUKTA, P.DUP_MARKS))
SPLIT = re.compile(f"([{P.TOKEN}]+)")
MEASURED = re.compile(f"[{P.TOKEN}]{{3,}}")


def normal_form(token: str) -> str:
    """repair.normalize_token()"""
    token = token.replace("\u200c", "").replace("\u200d", "")
    for _ in range(4):
        before = token
        for regex, to in _COLLAPSE:
            token = regex.sub(to, token)
        for a, b in P.SIGN_SEQUENCES:
            token = token.replace(a, b)
        if token == before:
            break
    return token.replace(P.NUKTA, "").replace(P.HALANT, "")


def _considered_clean(token: str) -> bool:
    """Whether P.CONSIDER matches where _NOISY does not."""
    return bool(
        _SUSPICIOUS.search(token)
        or ("\u091c" in token and _J_SWAP.search(token))
        or (P.NUKTA in token and _NUKTA.search(token))
        or (token[:1] == P.I_SIGN and _LEADING_I.search(token))
    )


def _swapped(token: str) -> str | None:
    """lexicon.swap_j()"""
    if (token[:1] == P.I_SIGN or "\u091c" in token) and (_LEADING_I.search(token) or _J_SWAP.search(token)):
        out = _J_SWAP.sub(rf"\1{P.I_SIGN}", _LEADING_I.sub("\u091c", token))
        return out if out != token else None
    return None


def _shorter(token: str) -> tuple[str, ...]:
    """lexicon.without_i()"""
    if P.I_SIGN not in token or not _any(token, _STRAY_I):
        return ()
    return tuple({token[:i] + token[i + 1 :] for i in range(len(token) - 1) if token[i] == P.I_SIGN})


class Distance:
    """Edit distances from one text, by bits."""

    def __init__(self, text: str) -> None:
        self.n, self.at = len(text), {}
        for i, c in enumerate(text):
            self.at[c] = self.at.get(c, 0) | 1 << i

    def to(self, other: str) -> int:
        full, top = (1 << self.n) - 1, 1 << (self.n - 1)
        up, down, out = full, 0, self.n
        for c in other:
            eq = self.at.get(c, 0)
            x = (((eq & up) + up) ^ up) | eq
            y = eq | down
            plus, minus = down | (full & ~(x | up)), up & x
            out += 1 if plus & top else -1 if minus & top else 0
            plus, minus = (plus << 1 | 1) & full, minus << 1 & full
            up, down = minus | (full & ~(y | plus)), plus & y
        return out


class Words:
    """Words by their normal forms."""

    def __init__(self, words: Iterable[str]) -> None:
        self.words = frozenset(words)
        self.norms: dict[str, list[str]] = {}
        for w in self.words:
            self.norms.setdefault(normal_form(w), []).append(w)
        self.near: dict[tuple[str, int], list[str]] = {}
        for norm in self.norms:
            if norm:
                self.near.setdefault((norm[0], len(norm)), []).append(norm)


_NONE = Words(())


class Resolver:
    """Fixes of tokens by a set of words and, where they are given, further words of a context."""

    def __init__(self, words: frozenset[str], max_distance: int, min_token_length: int) -> None:
        self.base, self.max_distance, self.least = Words(words), max_distance, min_token_length
        self.seen: dict[str, tuple] = {}
        self.fixes: dict[str, tuple | None] = {}

    def _look(self, token: str) -> tuple:
        """What the context doesn't change: normal form, proposals, whether it is considered and may be guessed, words of its form."""
        found = self.seen.get(token)
        if found is None:
            noisy = _NOISY.search(token) is not None
            norm = normal_form(token) if noisy else token.replace(P.NUKTA, "").replace(P.HALANT, "")
            plain = norm if noisy and norm != token and _any(token, _STRUCTURAL) else None
            considered = len(token) >= self.least and (_any(token, _CONSIDER) if noisy else _considered_clean(token))
            guessed = considered and norm != "" and not _any(token, _NO_GUESS)
            found = norm, _swapped(token), _shorter(token), plain, considered, guessed, self.base.norms.get(norm, ()) if norm else ()
            if len(self.seen) >= MOST_WORDS:
                self.seen.clear()
            self.seen[token] = found
        return found

    def exact(self, token: str, context: Words = _NONE) -> tuple[str, bool, str | None]:
        """(normal form, whether it is a word, what it stands for by the exact rules)"""
        words, own = self.base.words, context.words
        norm, swap, shorter, plain, _, _, same = self._look(token)
        if token in words or token in own:
            return norm, True, token
        if swap is not None and (swap in words or swap in own):
            return norm, False, swap
        if shorter:
            cut = [w for w in shorter if w in words or w in own]
            if len(cut) == 1:
                return norm, False, cut[0]
        if plain is not None and (plain in words or plain in own):
            return norm, False, plain
        if norm and norm in context.norms:
            same = list({*same, *context.norms[norm]})
        return norm, False, same[0] if len(same) == 1 else None

    def _guess(self, token: str, norm: str, context: Words) -> str | None:
        size = len(norm)
        allowed = min(self.max_distance, 1 if size <= 4 else 2 if size <= 7 else 3)
        nukta, distance = _NUKTA.search(token) is not None, Distance(norm)
        found: dict[str, tuple] = {}
        for s in (self.base, context):
            for n in range(max(1, size - allowed), size + allowed + 1):
                for other in s.near.get((norm[0], n), ()) if allowed else ([norm] if norm in s.norms else ()):
                    d = distance.to(other)
                    if d > allowed or not (d <= 1 or norm[:2] == other[:2] or norm[-3:] == other[-3:]):
                        continue
                    for w in s.norms[other]:
                        if not nukta or token[-1] == w[-1]:
                            found[w] = (d, (token[:2] != w[:2]) + (token[-1] != w[-1]), abs(len(w) - len(token)))
        if not found:
            return None
        least = min(found.values())
        best = [w for w, score in found.items() if score == least]
        return best[0] if len(best) == 1 else None

    def _resolve(self, token: str, context: Words = _NONE) -> tuple[str | None, str | None] | None:
        norm, known, exact = self.exact(token, context)
        if known:
            return None
        if exact is not None:
            return exact, "exact"
        *_, considered, guessed, _ = self._look(token)
        if not considered:
            return None
        guess = self._guess(token, norm, context) if guessed else None
        return (None, None) if guess is None else (guess, "fuzzy")

    def resolve(self, token: str, context: Words | None = None) -> tuple[str | None, str | None] | None:
        """(what it becomes, why); nulls where it is considered and stays, None where it is not considered."""
        if context is not None:
            return self._resolve(token, context)
        try:
            return self.fixes[token]
        except KeyError:
            if len(self.fixes) >= MOST_WORDS:
                self.fixes.clear()
            found = self.fixes[token] = self._resolve(token)
            return found

    def group(self, texts: list[str | None], whole: bool = True) -> list[dict]:
        """A row a text of one group: text, statistics, the number of the group's own words (none unless ``whole``), and hits before and after."""
        parts = [None if t is None else SPLIT.split(t) for t in texts]
        counts: Counter = Counter()
        for p in parts:
            counts.update(p[1::2] if p else ())
        own = self.recurring(counts) if whole else []
        context = Words(own) if own else None
        found = {t: self.resolve(t, context) for t in counts}
        known = self.base.words.union(own)
        rows = []
        for p in parts:
            before = sum(len(t) >= 3 for t in filter(known.__contains__, p[1::2])) if p else 0
            row = rebuilt(p, found, 20)
            after = sum(map(known.__contains__, MEASURED.findall(row["text"]))) if row["stats"]["corrected_tokens"] else before
            rows.append(row | {"words": len(own), "before": before, "after": after})
        return rows

    def recurring(self, counts: Counter, min_frequency: int = 2, min_token_length: int = 4) -> list[str]:
        """lexicon.contextual_lexicon() of one group"""
        words = self.base.words
        return [t for t, n in counts.items() if n >= min_frequency and len(t) >= min_token_length and t not in words and not _any(t, _UNCLEAN)]


@cache
def resolver(words: frozenset[str], max_distance: int, min_token_length: int) -> Resolver:
    return Resolver(words, max_distance, min_token_length)


def rebuilt(parts: list[str] | None, found: dict[str, tuple | None], most: int) -> dict:
    """Text and statistics from the pieces that SPLIT gives, tokens at the odd places; ``found`` has their fixes."""
    if parts is None:
        return {"text": None, "stats": {"tokens_seen": 0, "tokens_considered": 0, "corrected_tokens": 0, "corrections": [], "rule_counts": []}}
    tokens = parts[1::2]
    asked = [(t, f) for t, f in zip(tokens, map(found.__getitem__, tokens)) if f is not None]
    done = [(t, *f) for t, f in asked if f[0] is not None]
    if done:
        to = {t: new for t, new, _ in done}
        parts[1::2] = [to.get(t, t) for t in tokens]
    listed = [{"from": t, "to": new, "reason": reason} for t, new, reason in done[:most]]
    counts = Counter(reason for *_, reason in done)
    return {"text": "".join(parts), "stats": {"tokens_seen": len(tokens), "tokens_considered": len(asked), "corrected_tokens": len(done), "corrections": listed, "rule_counts": list(counts.items())}}
