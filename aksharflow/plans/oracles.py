"""Builders of SQL (DuckDB dialect) for the reference results of the queries; its regular expressions know neither lookaround nor back references."""

from __future__ import annotations

from ..functions import detect as D
from ..functions import glyphs
from ..functions import patterns as P
from ..functions.repair import steps


def q(text: str) -> str:
    """A string literal; control and quote characters survive."""
    return "'" + text.replace("'", "''") + "'"


def deva(lo: int, hi: int) -> list[str]:
    return [chr(i) for i in range(lo, hi + 1)]


def members(char_class: str) -> list[str]:
    """The characters of a class body made of characters and ranges."""
    out, i = [], 0
    while i < len(char_class):
        if i + 2 < len(char_class) and char_class[i + 1] == "-":
            out += deva(ord(char_class[i]), ord(char_class[i + 2]))
            i += 3
        else:
            out.append(char_class[i])
            i += 1
    return out


def occurrences(text: str, part: str) -> str:
    return f"((length({text}) - length(replace({text}, {q(part)}, ''))) // {len(part)})"


def count(text: str, regex: str) -> str:
    return f"len(regexp_extract_all({text}, {q(regex)}))"


def total(text: str, parts: tuple[str, ...]) -> str:
    return "(" + " + ".join(occurrences(text, p) for p in parts) + ")"


def encoding(text: str) -> tuple[str, str]:
    """(has_issues, font) as expressions."""
    k, c, g = (total(text, s) for s in (D.KRUTIDEV_SIGNS, D.CHANAKYA_SIGNS, D.GENERAL_SIGNS))
    share = f"({count(text, f'[{P.DEVA}]')} / length({text})::double)"
    has = f"(coalesce(length({text}), 0) > 0 and {share} < 0.1 and {k} + {c} + {g} > 4)"
    return has, f"(case when not {has} then 'unknown' when {k} >= {c} then 'krutidev' else 'chanakya' end)"


def conversion(text: str, font: str) -> str:
    table = glyphs.mapping(font)
    keys = sorted(table, key=lambda k: (-len(k), k))
    regex = "(?s)" + "|".join("\\Q" + k + "\\E" for k in keys) + "|."
    pairs = "map {" + ", ".join(f"{q(k)}: {q(v)}" for k, v in sorted(table.items())) + "}"
    out = f"array_to_string(list_transform(regexp_extract_all({text}, {q(regex)}), lambda x: coalesce({pairs}[x], x)), '')"
    if font in glyphs.REORDERED:
        out = f"regexp_replace({out}, {q(f'{P.I_SIGN}(' + chr(0x902) + f'?)({P.CLUSTER})')}, {q(chr(92) + '2' + P.I_SIGN + chr(92) + '1')}, 'g')"
    return out


def _rx(regex: str, to: str) -> str:
    return f"regexp_replace(t, {q(regex)}, {q(to)}, 'g')"


def chain(repair: bool) -> list[str]:
    """The repair chain as expressions over ``t``, each applied to the result of the one before."""
    ws = r"[\s]"
    c, cp, marks = members(P.C), members(P.CP), members(P.MARKS)
    out: list[str] = []
    for regex, to in steps(repair):
        if regex == P.STRAY_ZWJ:
            out += [_rx(f"{P.ZWJ}([{P.MARKS}])", r"\1"), _rx(f"([{P.MARKS}]){P.ZWJ}", r"\1")]
        elif regex == P.HALANT_DUP:
            out.append("replace_chain:" + "|".join(P.HALANT + x + x + ">" + P.HALANT + x for x in cp))
        elif regex.endswith(f"(?={chr(0x902)})"):
            e = regex[0]
            out.append(f"replace(t, {q(e + e + chr(0x902))}, {q(e + chr(0x902))})")
        elif regex.startswith(f"(^|{P.WS})"):
            out.append(_rx(f"(^|{ws})[{P.MARKS}]([{P.C}])", r"\1\2"))
        elif regex.startswith(f"([{P.C}])\\1(?="):
            out.append("replace_chain:" + "|".join(x + x + ">" + x + "\x01" for x in c))
            # a mark whose follower is neither a consonant nor a nasal sign goes back to the consonant before it
            nasal = "".join(deva(0x901, 0x903))
            out.append(_rx(f"([{P.C}])\x01([^{P.C}{nasal}]|$)", r"\1\1\2"))
            out.append(f"replace(t, chr(1), {q(P.I_SIGN)})")
        elif regex.startswith("([" + chr(0x921)):
            out += [f"replace(t, {q(x + x + P.NUKTA)}, {q(x + P.NUKTA + P.I_SIGN)})" for x in chr(0x921) + chr(0x922)]
        elif regex.startswith("(?<!"):
            for a in P.AUXILIARIES:
                out += [_rx(f"(^|[^{P.TOKEN}]){a}{a}([^{P.TOKEN}]|$)", r"\1" + a + r"\2")] * 2
        elif regex == P.DUP_MARK_CLUSTER:
            for v in members(P.VOWELS):
                for n in deva(0x901, 0x902):
                    out.append(_rx(f"(?:{v}{n}){{2,}}", v + n))
        else:
            out.append(_rx(regex.replace(P.WS, ws), to.replace("$1", r"\1").replace("$2", r"\2")))
    _ = marks
    flat: list[str] = []
    for step in out:
        if step.startswith("replace_chain:"):
            for pair in step.removeprefix("replace_chain:").split("|"):
                a, b = pair.split(">")
                flat.append(f"replace(t, {q(a)}, {q(b)})")
        else:
            flat.append(step)
    return flat


def staged(source: str, expressions: list[str], keep: str, name: str = "s", size: int = 20) -> str:
    """CTEs that apply ``expressions`` to column t of ``source``, ``size`` at a time; the last is called ``name``."""
    parts, at = [], source
    blocks = [expressions[i : i + size] for i in range(0, len(expressions), size)]
    for i, block in enumerate(blocks):
        e = "t"
        for x in block:
            e = x.replace("(t,", f"({e},", 1)
        own = name if i == len(blocks) - 1 else f"{name}{i}"
        parts.append(f"{own} as materialized (select {keep}, {e} as t from {at})")
        at = own
    return ",\n".join(parts)


def token_list(text: str) -> str:
    return f"regexp_extract_all({text}, {q(P.TOKENS)})"


def artifacts(text: str) -> dict[str, str]:
    """The artefact counters over texts whose only white space is blanks and line breaks."""
    ws = r"\s"
    double = "(" + " + ".join(count(text, m + m) for m in members(P.DOUBLED + chr(0x949))) + ")"
    # a mark can begin a text or a word once only, so that consuming what follows it never hides another one
    return {
        "control_chars": count(text, P.CONTROL),
        "stray_zwj": "0",
        "leading_matra": count(text, f"(^|{ws})[{P.MARKS}][{P.C}]"),
        "detached_mark": count(text, f"[{P.CP}]{ws}+[{P.MARKS}]"),
        "halant_space": count(text, f"{P.HALANT}{ws}+[{P.DEVA}]"),
        "duplicate_marks": double,
        "double_e_anusvara": count(text, chr(0x947) * 2 + chr(0x902)),
    }


def noise(text: str) -> str:
    """All noise of a text, its Latin letters included; the classes are spelled out here and not taken from the patterns."""
    deva_ = "\u0900-\u097f"
    marks = "\u093c\u0901-\u0903\u093e-\u0943\u0947-\u0949\u094b-\u094d"
    vowels = "\u093e-\u0943\u0945\u0947-\u0949\u094b\u094c"
    odd = "\u091a\u091b\u091d-\u0920\u0924-\u0928\u092a\u092c-\u0930\u0932\u0935-\u0939\u091e"
    doubled = [*deva(0x901, 0x903), chr(0x93C), *deva(0x93E, 0x943), chr(0x947), chr(0x948), *deva(0x94B, 0x94D)]
    parts = [f"[{deva_}]\\s+[{marks}]", f"\u094d\\s+[{deva_}]", f"[{odd}]\u094d?\u093c", f"[{vowels}][\u0901-\u0903]?[{vowels}]", "[A-Za-z]", *(m + "{2,}" for m in doubled)]
    return "(" + " + ".join(count(text, x) for x in parts) + ")"


def words_table(words: frozenset[str]) -> str:
    return "(values " + ", ".join(f"({q(w)})" for w in sorted(words)) + ") w(word)"
