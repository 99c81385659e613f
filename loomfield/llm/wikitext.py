"""Reading wiki markup: the words of a text wherever they stand, and its running prose."""

from __future__ import annotations

import html
import re
import unicodedata

# Letters of other alphabets that look like Latin ones.
LOOKALIKES = str.maketrans(
    "АВЕКМНОРСТУХаеосрухіјѕһԁԛԝ" + "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧαινορυχ" + "ıſ",
    "ABEKMHOPCTYXaeocpyxijshdqw" + "ABEZHIKMNOPTYXaivopux" + "is",
)

_WORD = re.compile(r"[^\W_]+")
_COMMENT = re.compile(r"<!--(.*?)-->", re.S)
_REF_EMPTY = re.compile(r"<ref\b[^<>]*/>", re.I)
_REF = re.compile(r"<ref\b[^<>]*>((?:(?!<ref\b).)*?)</ref\s*>", re.I | re.S)
_BLOCK_TAG = re.compile(r"</?(?:br|p|div|blockquote|poem|table|tr|td|th|li|ul|ol|dl|dd|dt|gallery|center|h[1-6])\b[^<>]*>", re.I)
_TAG = re.compile(r"</?[a-z][^<>]*>", re.I)
_TEMPLATE = re.compile(r"\{\{([^{}]*)\}\}")
_LINK = re.compile(r"\[\[([^\[\]]*)\]\]")
_WEB = re.compile(r"\[(?:https?:)?//[^\s\]]*\s*([^\]]*)\]")
_QUOTES = re.compile(r"''+")


def plain_letters(text: str) -> str:
    """One encoding of the letters: compatibility forms, no accents, no format characters, Latin lookalikes."""
    if text.isascii():
        return text
    text = unicodedata.normalize("NFKD", text).translate(LOOKALIKES)
    return "".join(c for c in text if not unicodedata.combining(c) and unicodedata.category(c) != "Cf")


def _link_text(m: re.Match) -> str:
    return m[1].rpartition("|")[2]


def all_segments(text: str) -> list[list[str]]:
    """The words of the running text and, apart from it, of each note, template and comment, in lower case.

    Nothing is left out: what interrupts a passage without being part of it
    (a note, a template, a comment) becomes a segment of its own.
    """
    parts = [text]

    def out(m: re.Match) -> str:
        if m[1] and not m[1].isspace():
            parts.append(m[1])
        return " "

    done = []
    for t in parts:  # grows while it runs; each part taken out is shorter than what it stood in
        if "<" in t:
            t = _COMMENT.sub(out, t)
            t = _REF_EMPTY.sub("", t)
            n = "<ref" in t or "<REF" in t
            while n:
                t, n = _REF.subn(out, t)
        n = "{{" in t
        while n:
            t, n = _TEMPLATE.subn(out, t)
        if w := _words(t):
            done.append(w)
    return done


def _words(t: str) -> list[str]:
    if "<" in t:
        t = _TAG.sub("", _BLOCK_TAG.sub(" ", t))
    if "[" in t:
        t = _WEB.sub(r" \1 ", _LINK.sub(_link_text, t))
    if "''" in t:
        t = _QUOTES.sub("", t)
    if "&" in t:
        t = html.unescape(html.unescape(t))
    return _WORD.findall(plain_letters(t).casefold())


# --- running prose ---------------------------------------------------------------------------

# Link prefixes of categories, files and languages' names for them.
_ASIDE = re.compile(r"\s*:?(?:category|kategorie|catégorie|categoría|file|image|datei|bild|fichier|archivo|imagen)\s*:", re.I)
# The words a redirect begins with.
_REDIRECT = re.compile(r"\s*#\s*(?:redirect|redirection|weiterleitung|redirección)", re.I)
_OPEN_COMMENT = re.compile(r"<!--.*\Z", re.S)
_OPEN_REF = re.compile(r"<ref\b[^<>]*>[^<\n]*", re.I)
_MASKED = re.compile(r"<(math|code|pre|nowiki|gallery|timeline|score|syntaxhighlight|source)\b[^<>]*>.*?</\1\s*>", re.I | re.S)
_TABLE = re.compile(r"^[ \t:]*\{\|(?:(?!^[ \t:]*\{\|).)*?^[ \t]*\|\}", re.S | re.M)
_HEADING = re.compile(r"={2,6}[^=\n]+={2,6}")
_NOT_PROSE = re.compile(r"^[ \t]*[*#:;|!{}=\[<]")
_EMPHASIS_RUN = re.compile(r"[!?]{3,}")
_SENTENCE_END = re.compile(r"(?<!\b[A-Z][a-z])(?<!\b[A-Z])[.!?]+(?=\s|$)")


def _marks() -> str:
    """Ranges of the marks that are written with a letter and belong to its word."""
    places = [i for i in range(0x300, 0x10000) if unicodedata.category(chr(i)) in ("Mn", "Mc")]
    out, first = [], places[0]
    for a, b in zip(places, [*places[1:], -1]):
        if b != a + 1:
            out.append(f"\\u{first:04x}-\\u{a:04x}")
            first = b
    return "".join(out)


_LETTERS = f"(?:[^\\W\\d_]|[{_marks()}])+"
_TOKEN = re.compile(rf"{_LETTERS}(?:['’-]{_LETTERS})*|\d+")
_ASCII_TOKEN = re.compile(r"[A-Za-z]+(?:['-][A-Za-z]+)*|[0-9]+")
# Letters of scripts that set no spaces between words, with how many of them make a word on average.
_UNSPACED = [(re.compile("[\u3040-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003134f]"), 2), (re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff]"), 4)]
_UNSPACED_RUN = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff]+|[\u3040-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003134f]+")
_STOP = re.compile(r"[.!?:;,。！？｡]")
_WIDE_STOP = re.compile("[。！？｡]+")
LONGEST_WORD = 60


def _prose_link(m: re.Match) -> str:
    return "" if _ASIDE.match(m[1]) else m[1].rpartition("|")[2]


def prose_sentences(text: str) -> list[list[str]]:
    """The running prose of a page as sentences of words, as written.

    Tables, lists, headings, templates, notes, categories, comments and
    redirects are no prose; nor are lines of shouting, of mashed keys, of one
    word over and over, or without any sentence.
    """
    if not text or _REDIRECT.match(text):
        return []
    text = _EMPHASIS_RUN.sub(" ", text)  # before markup is told by the character a line begins with
    if "<" in text:
        text = _OPEN_COMMENT.sub("", _COMMENT.sub("", text))
        text = _MASKED.sub(" ", _REF_EMPTY.sub("", text))
        n = True
        while n:
            text, n = _REF.subn("", text)
        text = _OPEN_REF.sub("", text)
    n = "{{" in text
    while n:
        text, n = _TEMPLATE.subn("", text)
    if "{|" in text:
        n = True
        while n:
            text, n = _TABLE.subn("", text)
    if "<" in text:
        text = _TAG.sub("", _BLOCK_TAG.sub("\n", text))
    if "[" in text:
        n = True
        while n:
            text, n = _LINK.subn(_prose_link, text)
        text = _WEB.sub("", text)
    if "==" in text:
        text = _HEADING.sub("\n", text)
    if "''" in text:
        text = _QUOTES.sub("", text)
    if "&" in text:
        text = html.unescape(text)
    out = []
    for line in text.split("\n"):
        if _NOT_PROSE.match(line) or "||" in line or "{{" in line:
            continue
        line = unicodedata.normalize("NFC", line).replace("\u00ad", "").replace("\u200b", "")
        if not _STOP.search(line) and len(_prose_words(line)) < 3:
            continue  # a word or two that end nowhere are a label, not a sentence
        for s in _SENTENCE_END.split(line if line.isascii() else _WIDE_STOP.sub(". ", line)):
            words = _prose_words(s)
            if words and _readable(words):
                out.append(words)
    return out


def _prose_words(s: str) -> list[str]:
    """Words as written; a run of letters that sets no spaces is cut into words of the script's usual length, and what is no word is left out."""
    if s.isascii():
        words = _ASCII_TOKEN.findall(s)
    else:
        words = _TOKEN.findall(_UNSPACED_RUN.sub(_spaced, s))
    return [w for w in words if len(w) <= LONGEST_WORD] if len(s) > LONGEST_WORD else words


def _spaced(m: re.Match) -> str:
    run = m[0]
    n = next(n for script, n in _UNSPACED if script.match(run))
    return " " + " ".join(run[i : i + n] for i in range(0, len(run), n)) + " "


def _readable(words: list[str]) -> bool:
    """Neither shouted nor one word over and over."""
    n = len(words)
    if sum(w.isupper() and len(w) > 1 for w in words) > n / 2:
        return False
    return len({w.lower() for w in words}) > n / 4
