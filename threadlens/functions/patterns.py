"""Fixed values.

Every regular expression here is written so that Java (Spark) and RE2
(DuckDB, used as the test oracle) read it the same way: no ``\\s``, ``\\S``,
``\\w``, ``.`` or ``$``, whose meaning differs between engines and from
Python's. Character classes are spelled out as code-point ranges instead.
"""

# --- Fixed values: Python's whitespace class (str.isspace), as ranges. -------
WS = (r"\x{09}-\x{0d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
      r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}")
# The same class as a string of its characters.
WS_CHARS = "".join(chr(c) for c in range(0x110000) if chr(c).isspace())

# --- Fixed values: the comment-markup cleaning stages, in the order they run.
# (switch, pattern, replacement); "$1" is the first captured group.
CLEAN_STAGES = (
    ("newline", r"\n+", " "),
    ("newline", rf"^[{WS}]+|[{WS}]+\z", ""),
    ("newline", rf"[{WS}][{WS}]+", " "),
    ("quote", r'"?\\?&?gt;?', ""),
    ("bullet_point", r"\*", ""),
    ("bullet_point", r"&amp;#x200B;", ""),
    ("bullet_point", r"&amp;", ""),
    ("link", rf"http[^{WS}]+", "[URL]"),
    ("strikethrough", r"~", ""),
    ("spoiler", r"&lt;", ""),
    ("spoiler", r"!([^\n]*?)!", "$1"),
    ("code", r"`", ""),
    ("superscript", r"\^\(([^\n]*?)\)", "$1"),
    ("table", r"\|", " "),
    ("table", r":-", ""),
    ("heading", r"#", ""),
)
# Stages whose pattern is one literal, and the trim: run without the regex engine.
CLEAN_LITERALS = {r"\*": "*", "&amp;#x200B;": "&amp;#x200B;", "&amp;": "&amp;", "~": "~", "&lt;": "&lt;",
                  "`": "`", r"\|": "|", ":-": ":-", "#": "#"}
CLEAN_TRIM = rf"^[{WS}]+|[{WS}]+\z"
CLEAN_SWITCHES = ("newline", "quote", "bullet_point", "link", "strikethrough",
                  "spoiler", "code", "superscript", "table", "heading")

# --- Fixed values: characters Python's str.isdigit accepts beyond \p{Nd}. ----
DIGIT_EXTRA = (r"\x{b2}-\x{b3}\x{b9}\x{1369}-\x{1371}\x{19da}\x{2070}\x{2074}-\x{2079}"
               r"\x{2080}-\x{2089}\x{2460}-\x{2468}\x{2474}-\x{247c}\x{2488}-\x{2490}"
               r"\x{24ea}\x{24f5}-\x{24fd}\x{24ff}\x{2776}-\x{277e}\x{2780}-\x{2788}"
               r"\x{278a}-\x{2792}\x{10a40}-\x{10a43}\x{10e60}-\x{10e68}"
               r"\x{11052}-\x{1105a}\x{1f100}-\x{1f10a}")
DIGIT = rf"[\p{{Nd}}{DIGIT_EXTRA}]"

# --- Fixed values: the characters with the Emoji property of Unicode 18.0, but digits, # and *
# (emoji as keycaps only) and regional indicators (in pairs only). A sequence counts once:
# a flag, a keycap, a character with a presentation mark, skin tone or tags, or several
# of these around joiners.
EMOJI_BASE = ("["
              r"\x{a9}\x{ae}\x{203c}\x{2049}\x{2122}\x{2139}\x{2194}-\x{2199}\x{21a9}-\x{21aa}\x{231a}-\x{231b}"
              r"\x{2328}\x{23cf}\x{23e9}-\x{23f3}\x{23f8}-\x{23fa}\x{24c2}\x{25aa}-\x{25ab}\x{25b6}\x{25c0}"
              r"\x{25fb}-\x{25fe}\x{2600}-\x{2604}\x{260e}\x{2611}\x{2614}-\x{2615}\x{2618}\x{261d}\x{2620}"
              r"\x{2622}-\x{2623}\x{2626}\x{262a}\x{262e}-\x{262f}\x{2638}-\x{263a}\x{2640}\x{2642}\x{2648}-\x{2653}"
              r"\x{265f}-\x{2660}\x{2663}\x{2665}-\x{2666}\x{2668}\x{267b}\x{267e}-\x{267f}\x{2692}-\x{2697}\x{2699}"
              r"\x{269b}-\x{269c}\x{26a0}-\x{26a1}\x{26a7}\x{26aa}-\x{26ab}\x{26b0}-\x{26b1}\x{26bd}-\x{26be}"
              r"\x{26c4}-\x{26c5}\x{26c8}\x{26ce}-\x{26cf}\x{26d1}\x{26d3}-\x{26d4}\x{26e9}-\x{26ea}"
              r"\x{26f0}-\x{26f5}\x{26f7}-\x{26fa}\x{26fd}\x{2702}\x{2705}\x{2708}-\x{270d}\x{270f}\x{2712}\x{2714}"
              r"\x{2716}\x{271d}\x{2721}\x{2728}\x{2733}-\x{2734}\x{2744}\x{2747}\x{274c}\x{274e}\x{2753}-\x{2755}"
              r"\x{2757}\x{2763}-\x{2764}\x{2795}-\x{2797}\x{27a1}\x{27b0}\x{27bf}\x{2934}-\x{2935}\x{2b05}-\x{2b07}"
              r"\x{2b1b}-\x{2b1c}\x{2b50}\x{2b55}\x{3030}\x{303d}\x{3297}\x{3299}\x{1f004}\x{1f0cf}"
              r"\x{1f170}-\x{1f171}\x{1f17e}-\x{1f17f}\x{1f18e}\x{1f191}-\x{1f19a}\x{1f201}-\x{1f202}\x{1f21a}"
              r"\x{1f22f}\x{1f232}-\x{1f23a}\x{1f250}-\x{1f251}\x{1f300}-\x{1f321}\x{1f324}-\x{1f393}"
              r"\x{1f396}-\x{1f397}\x{1f399}-\x{1f39b}\x{1f39e}-\x{1f3f0}\x{1f3f3}-\x{1f3f5}\x{1f3f7}-\x{1f4fd}"
              r"\x{1f4ff}-\x{1f53d}\x{1f549}-\x{1f54e}\x{1f550}-\x{1f567}\x{1f56f}-\x{1f570}\x{1f573}-\x{1f57a}"
              r"\x{1f587}\x{1f58a}-\x{1f58d}\x{1f590}\x{1f595}-\x{1f596}\x{1f5a4}-\x{1f5a5}\x{1f5a8}"
              r"\x{1f5b1}-\x{1f5b2}\x{1f5bc}\x{1f5c2}-\x{1f5c4}\x{1f5d1}-\x{1f5d3}\x{1f5dc}-\x{1f5de}\x{1f5e1}"
              r"\x{1f5e3}\x{1f5e8}\x{1f5ef}\x{1f5f3}\x{1f5fa}-\x{1f64f}\x{1f680}-\x{1f6c5}\x{1f6cb}-\x{1f6d2}"
              r"\x{1f6d5}-\x{1f6d9}\x{1f6dc}-\x{1f6e5}\x{1f6e9}\x{1f6eb}-\x{1f6ec}\x{1f6f0}\x{1f6f3}-\x{1f6fc}"
              r"\x{1f7e0}-\x{1f7eb}\x{1f7f0}\x{1f90c}-\x{1f93a}\x{1f93c}-\x{1f945}\x{1f947}-\x{1f9ff}"
              r"\x{1fa70}-\x{1fa7c}\x{1fa80}-\x{1fac6}\x{1fac8}\x{1facc}-\x{1fadd}\x{1fadf}-\x{1faeb}"
              r"\x{1faef}-\x{1fafa}"
              "]")
EMOJI_MOD = r"[\x{fe0e}\x{fe0f}\x{1f3fb}-\x{1f3ff}]*"
EMOJI_TAGS = r"(?:[\x{e0020}-\x{e007e}]+\x{e007f})?"
EMOJI = (r"[\x{1f1e6}-\x{1f1ff}]{2}|[0-9#*]\x{fe0f}?\x{20e3}|"
         rf"{EMOJI_BASE}{EMOJI_MOD}{EMOJI_TAGS}(?:\x{{200d}}{EMOJI_BASE}{EMOJI_MOD})*")

# --- Fixed values: rule-based sentence and word tokenisation. ----------------
SENTENCE_BREAK = rf"""[.!?]+["')\]]*[{WS}]+"""
NON_BLANK = rf"[^{WS}]"
WORD_TOKEN = (rf"[\p{{L}}\p{{N}}_]+(?:[-'][\p{{L}}\p{{N}}_]+)*|[^\p{{L}}\p{{N}}_{WS}]")
LEXICON_CHAR = r"[\p{L}\p{N}_]"
LEXICON_TOKEN = rf"{LEXICON_CHAR}+"
DOTTED_WORD = r"\p{L}+(?:\.\p{L}+)*\.?"
URL_PLACEHOLDER = r"\[URL\]"

# Variants for Spark's regex engine. It recurses for each repeat of a group unless the
# repeat is possessive; what may follow a repeat never overlaps with it, so giving nothing
# back changes no result. A sentence break starts at the first mark of a run, so that long
# runs are tried once. And it tries the ranges of a class one by one for every character,
# so a class is met with a coarse one that most characters fail at once, and small letters,
# which most characters are, stand first.
WS_SPARK = rf"[[\x{{09}}-\x{{0d}}\x{{1c}}-\x{{20}}\x{{85}}\x{{a0}}\x{{1680}}-\x{{3000}}]&&[{WS}]]"
DIGIT_SPARK = rf"[[0-9\x{{b2}}-\x{{10ffff}}]&&{DIGIT}]"
EMOJI_BASE_SPARK = rf"[[\x{{a9}}\x{{ae}}\x{{203c}}-\x{{3299}}\x{{1f004}}-\x{{1fafa}}]&&{EMOJI_BASE}]"
LEXICON_CHAR_SPARK = r"[a-z[0-9A-Z_][\x{aa}-\x{10ffff}&&[\p{L}\p{N}]]]"
LEXICON_TOKEN_SPARK = rf"{LEXICON_CHAR_SPARK}++"
MARK_SPARK = (r"[[!-/:-@\[-\^`{-~][\x{00}-\x{08}\x{0e}-\x{1b}\x{7f}-\x{10ffff}"
              rf"&&[^\p{{L}}\p{{N}}_{WS}]]]")
WORD_TOKEN_SPARK = rf"{LEXICON_CHAR_SPARK}++(?:[-']{LEXICON_CHAR_SPARK}++)*+|{MARK_SPARK}"
EMOJI_SPARK = (r"[\x{1f1e6}-\x{1f1ff}]{2}|[0-9#*]\x{fe0f}?\x{20e3}|"
               rf"{EMOJI_BASE_SPARK}{EMOJI_MOD}+{EMOJI_TAGS}(?:\x{{200d}}{EMOJI_BASE_SPARK}{EMOJI_MOD}+)*+")
SENTENCE_BREAK_SPARK = rf"""(?<![.!?])[.!?]++["')\]]*+{WS_SPARK}++"""
# A cleaning stage's pattern -> the same for Spark.
CLEAN_SPARK = {rf"[{WS}][{WS}]+": rf"{WS_SPARK}{WS_SPARK}+", r'"?\\?&?gt;?': r'(?=["\\&g])"?\\?&?gt;?'}

# --- Fixed values: strings pandas reads as missing in a CSV field. -----------
NA_WORDS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
            "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
            "nan", "null")
