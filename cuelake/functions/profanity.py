"""German profanity: what it is called, how it is masked, and its key for alignment."""

from __future__ import annotations

import functools
import re
import unicodedata

WORD = re.compile(r"[^\W\d_]+(?:\*+[^\W\d_]+)*")

# Name, its forms, letters one of which is masked, which of their places counts from 0.
# "scheiss" is also the beginning of longer words; no other name is.
TERMS = (
    ("arschloch", "arschloch arschloecher arschloechern", "a", 0),
    ("verdammt", "verdammt verdammte verdammter verdammtes verdammten verdammtem", "a", 0),
    ("mist", "mist mistkerl mistkerle miststueck miststuecke mistvieh", "i", 0),
    ("scheisse", "scheisse scheiss", "e", 0),
    ("bastard", "bastard bastarde bastarden bastards", "a", 0),
    ("idiot", "idiot idiotin idioten idiotinnen vollidiot vollidiotin vollidioten", "i", 1),
    ("dummkopf", "dummkopf dummkoepfe dummkoepfen", "u", 0),
    ("verarschen", "verarsch verarsche verarschst verarschen verarscht verarschte verarschten verarschung verarschungen", "a", 0),
    ("beschissen", "beschissen beschissene beschissener beschissenes beschissenen beschissenem", "i", 0),
    ("arsch", "arsch aersche aerschen arschgeige arschgeigen arschgesicht arschgesichter arschkarte", "a", 0),
    ("ficken", "fick ficke ficken fickst fickt fickte fickten gefickt gefickte gefickter geficktes gefickten geficktem verfickt verfickte verfickter verficktes verfickten verficktem", "i", 0),
    ("fotze", "fotze fotzen", "o", 0),
    ("hurensohn", "hurensohn hurensoehne hurensoehnen", "u", 0),
    ("hure", "hure huren", "u", 0),
    ("wichser", "wichser wichsern wichse wichsen wichst wichste wichsten gewichst", "i", 0),
    ("kacke", "kacke kacken kackst kackt kackte kackten kackhaufen kackbratze", "a", 0),
    ("pisse", "piss pisse pisser pissern pissen pisst pisste pissten verpiss verpisse verpissen verpisst verpisste verpissten angepisst", "i", 0),
    ("depp", "depp deppen", "e", 0),
    ("trottel", "trottel trotteln", "o", 0),
    ("bloedmann", "bloedmann bloedmaenner bloedmaennern", "oö", 0),
    ("schlampe", "schlampe schlampen", "a", 0),
    ("nutte", "nutte nutten", "u", 0),
    ("fresse", "fresse", "e", 0),
    ("vollpfosten", "vollpfosten", "o", 0),
    ("schwachkopf", "schwachkopf schwachkoepfe", "a", 0),
    ("saftsack", "saftsack saftsaecke", "a", 0),
    ("schwanzlutscher", "schwanzlutscher", "a", 0),
    ("armleuchter", "armleuchter", "e", 0),
    ("dumpfbacke", "dumpfbacke dumpfbacken", "u", 0),
    ("doedel", "doedel", "oö", 0),
    ("einfaltspinsel", "einfaltspinsel", "a", 0),
    ("hornochse", "hornochse hornochsen", "o", 0),
    ("schweinebacke", "schweinebacke schweinebacken", "e", 0),
    ("sackratte", "sackratte sackratten", "a", 0),
)
PREFIXES = {"scheisse": "scheiss"}

FORMS = {form: name for name, forms, _, _ in TERMS for form in {name, *forms.split()}}
MASKED = {name: (set(letters), nth) for name, _, letters, nth in TERMS}


def folded(token: str) -> str:
    t = unicodedata.normalize("NFC", token).casefold()
    for x, y in (("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("ß", "ss")):
        t = t.replace(x, y)
    return "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c))


def plain_name(form: str) -> str | None:
    """The name of an unmasked, folded word."""
    return FORMS.get(form) or next((name for name, prefix in PREFIXES.items() if form.startswith(prefix)), None)


@functools.lru_cache(1 << 14)
def masked_words(form: str) -> dict[str, frozenset[str]]:
    """Names a folded word with asterisks may stand for, each with the words that fit.

    Asterisks stand for one letter or more. Where no form fits, a prefix joined to what follows the
    last asterisks may.
    """
    if "*" not in form:
        return {}
    parts = re.split(r"\*+", form)
    fits = re.compile("[a-z]+".join(map(re.escape, parts))).fullmatch
    out: dict[str, set[str]] = {}
    for word, name in FORMS.items():
        if fits(word):
            out.setdefault(name, set()).add(word)
    for name, prefix in PREFIXES.items():
        shared = next((n for n in range(min(len(prefix), len(parts[-1])), 0, -1) if prefix.endswith(parts[-1][:n])), 0)
        if name not in out and fits(prefix + parts[-1][shared:]):
            out[name] = {prefix + parts[-1][shared:]}
    return {k: frozenset(v) for k, v in out.items()}


def profane_name(token: str) -> str | None:
    """The name of a profane word, masked or not; none where a mask leaves several."""
    form = folded(token)
    if "*" not in form:
        return plain_name(form)
    found = masked_words(form)
    return next(iter(found)) if len(found) == 1 else None


def alignment_key(token: str) -> str | None:
    """A profane word's own spelling, inflection kept; of a masked word the only one that fits (U14). ``normalize`` keeps what it made of it."""
    form = folded(token)
    if "*" not in form:
        return form if plain_name(form) else None
    words = {w for found in masked_words(form).values() for w in found}
    return words.pop() if len(words) == 1 else None


def mask(token: str, name: str) -> str:
    """One letter of a profane word as an asterisk: its name's, else the first vowel after the first letter."""
    letters, nth = MASKED[name]
    spots = [i for i, c in enumerate(token) if c.casefold() in letters]
    at = spots[nth] if nth < len(spots) else next((i for i, c in enumerate(token) if i and c.casefold() in "aeiouäöü"), None)
    return token if at is None else f"{token[:at]}*{token[at + 1:]}"


class Masks:
    """The source's own masks of an episode, each to be used once."""

    def __init__(self, source: list[tuple[int, str]], output: list[tuple[int, str]]):
        """Both are (cue, text) in order."""
        self.left = [(cue, set(masked_words(folded(w))), w) for cue, text in source for w in WORD.findall(text or "") if "*" in w and masked_words(folded(w))]
        self.wanted = {(cue, profane_name(w)) for cue, text in output for w in WORD.findall(text or "")}

    def take(self, cue: int, name: str) -> str | None:
        """The cue's own mask, else the first that no output word of its own cue waits for."""
        fits = [k for k, (_, names, _) in enumerate(self.left) if name in names]
        own = (k for k in fits if self.left[k][0] == cue)
        free = (k for k in fits if (self.left[k][0], name) not in self.wanted)
        k = next(own, None)
        k = next(free, None) if k is None else k
        return None if k is None else self.left.pop(k)[2]


def censor(text: str, cue: int, masks: Masks) -> tuple[str, list[tuple[str, str]]]:
    """(the text with profane words masked, what became of which); all else is left as it stands (U16)."""
    changes: list[tuple[str, str]] = []

    def replace(m: re.Match) -> str:
        word, name = m[0], profane_name(m[0])
        if name is None:
            return word
        new = masks.take(cue, name) or (word if "*" in word else mask(word, name))
        if new != word:
            changes.append((word, new))
        return new

    return WORD.sub(replace, text), changes


def censor_text(text: str | None, source: str | None = None) -> str | None:
    """One text by itself, with the masks of a source text if any."""
    return None if text is None else censor(text, 0, Masks([(0, source or "")], [(0, text)]))[0]
