"""From a text to the terms it is searched by; documents and queries go through the same chain.

`simple` is lower-case words of letters, and numbers, in any script. `english`
also leaves out stop words and stems the rest by the Porter2 rules. Commas that
group digits are dropped first, and the closed-up spelling of each hyphenated
word follows the text, so that either spelling is found.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A number with its decimals, or a word with its combining marks.
TERM = r"[\p{L}\p{M}]+|\p{Nd}+(?:\.\p{Nd}+)?"

#: A comma that groups digits.
DIGIT_COMMA = r"(?<=\d),(?=\d{2,3}(?!\d))"

#: Words that English searches leave out.
STOP_WORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs themselves "
    "what which who whom this that these those am is are was were be been being have has had having do does did doing a an the and but if or because as until while "
    "of at by for with about against between into through during before after above below to from up down in out on off over under again further then once here there "
    "when where why how all any both each few more most other some such no nor not only own same so than too very s t can will just don should now"
).split()

#: Words whose stems no rule gives, and words that stay.
IRREGULAR = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
UNCHANGED = ("sky", "news", "howe", "atlas", "cosmos", "bias", "andes")
#: Words that stay once their plural ending is gone.
SETTLED = ("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed")


class UnknownConfig(ValueError):
    """A search configuration that does not exist."""


def join_digit_groups(text: Column) -> Column:
    """Commas between digit groups dropped: 1,23,456 becomes 123456."""
    return F.regexp_replace(text, DIGIT_COMMA, "")


def for_analysis(text: Column) -> Column:
    """Digit groups joined, and the closed-up spellings of hyphenated words after the text."""
    joined = join_digit_groups(text)
    parted = F.regexp_extract_all(joined, F.lit(r"(\p{L}+(?:-\p{L}+)+)"), F.lit(1))
    return F.concat_ws(" ", joined, F.array_join(F.transform(parted, lambda w: F.replace(w, F.lit("-"), F.lit(""))), " "))


_V, _N = "[aeiouy]", "[^aeiouy]"
#: What lies before a word's first region and before its second: up to the consonant after the first vowels, and once more.
_R1 = f"(?>gener|commun|arsen|{_N}*{_V}+{_N})"
_R2 = f"{_R1}{_N}*{_V}+{_N}"
#: A short syllable, at a word's end and at its beginning.
_SHORT, _SHORT_FIRST = f"{_N}{_V}[^aeiouywxY]", f"{_V}{_N}"

#: The steps in order: the endings a word must have one of (none: any word with a y), then patterns and replacements. A tilde stands where `ed` or `ing` was.
_STEPS = (
    # y as a consonant is written Y
    ((), [(r"^y|(?<=[aeiou])y|(?<=[^aeiouy]y)y", "Y")]),
    # plurals
    (("s", "d"), [("sses$", "ss"), ("^(.)ie[sd]$", "$1ie"), ("(?<=..)ie[sd]$", "i"), (f"({_V}.*[^us])s$", "$1")]),
    # past and gerund
    (
        ("ed", "ng", "ly"),
        [
            (f"^({_R1}.*?)eed(?:ly)?$", "$1ee"),
            (f"^(.*{_V}.*?)(?:(?<!e)ed|ing)(?:ly)?$", "$1~"),
            ("(at|bl|iz)~$", "$1e"),
            (r"([bdfgmnprt])\1~$", "$1"),
            (f"^(gener|commun|arsen|{_N}+{_V}[^aeiouywxY]|{_SHORT_FIRST})~$", "$1e"),
            ("~$", ""),
        ],
    ),
    (("y", "Y"), [(f"^(.+{_N})[yY]$", "$1i")]),
    # double suffixes to single ones
    (
        ("al", "ci", "li", "er", "on", "or", "sm", "ti", "ss", "gi"),
        [
            (f"^({_R1}.*?)((?<!iz)at(?=ion$)|at(?=ional$|or$)|iz(?=er$|ation$)|[ea]nc(?=i$)|abl(?=i$)|iv(?=eness$|iti$))[a-z]+$", "$1$2e"),
            (f"^({_R1}.*?)(tion(?=al$)|ent(?=li$)|al(?=ism$|iti$|li$)|ful(?=ness$|li$)|ous(?=ness$|li$)|less(?=li$)|(?<=l)og(?=i$))[a-z]+$", "$1$2"),
            (f"^({_R1}.*?)b(?:iliti|li)$", "$1ble"),
            (f"^({_R1}.*)(?<=[cdeghkmnrt])(?<!ent)li$", "$1"),
        ],
    ),
    # and these to shorter ones
    (
        ("al", "ze", "te", "ti", "ul", "ss", "ve"),
        [
            (f"^({_R1}.*?)ational$", "$1ate"),
            (f"^({_R1}.*?(?:tion(?=al$)|al(?=ize$)|ic(?=ate$|iti$|al$)))[a-z]+$", "$1"),
            (f"^({_R1}.*?)(?:ful|ness)$", "$1"),
            (f"^({_R2}.*?)ative$", "$1"),
        ],
    ),
    # single suffixes
    (
        ("al", "ce", "er", "ic", "le", "nt", "sm", "te", "ti", "us", "ve", "ze", "on"),
        [(f"^({_R2}.*?)(?:ement|(?<!e)ment|(?<!m)ent|[ae]nce|[ai]ble|ant|ism|ate|iti|ous|ive|ize|al|er|ic|(?<=[st])ion)$", "$1")],
    ),
    # a last e or l
    (("e", "l"), [(f"^(?:({_R2}.*)e|({_R1}.*)(?<!{_SHORT})(?<!^{_SHORT_FIRST})e|({_R2}.*)(?<=l)l)$", "$1$2$3")]),
)


def _step(word: Column, endings: tuple[str, ...], rules: list) -> Column:
    """One step; `transform` over an array of one gives the word a name, so that it is worked out once."""

    def ruled(w: Column) -> Column:
        out = w
        for pattern, by in rules:
            out = F.regexp_replace(out, pattern, by)
        return F.when(F.right(w, F.lit(len(endings[0]))).isin(*endings) if endings else F.contains(w, F.lit("y")), out).otherwise(w)

    return F.element_at(F.transform(F.array(word), ruled), 1)


def stem(word: Column) -> Column:
    """A lower-case word's English stem; words of one or two letters are their own."""
    out = word
    for endings, rules in _STEPS:
        out = _step(out, endings, rules)
    alone = {raw: short for raw, short in IRREGULAR.items()} | {w: w for w in UNCHANGED} | {w + s: w for w in SETTLED for s in ("", "s")}
    known = F.create_map(*(F.lit(x) for pair in alone.items() for x in pair))
    return F.when(F.length(word) < 3, word).when(word.isin(*alone), F.element_at(known, word)).otherwise(F.lower(out))


def words(text: Column) -> Column:
    """The lower-case words and numbers of a text as it is, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"({TERM})"), F.lit(1))


def is_term(word: Column, config: str = "simple") -> Column:
    """Not a stop word of the configuration."""
    if config not in ("simple", "english"):
        raise UnknownConfig(config)
    return F.lit(True) if config == "simple" else ~word.isin(*STOP_WORDS)


def analysed(text: Column, config: str = "simple") -> Column:
    """The terms of a text or a query, in order."""
    own = words(for_analysis(text))
    if config == "simple":
        return own
    return F.transform(F.filter(own, lambda w: is_term(w, config)), stem)
