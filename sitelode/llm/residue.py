"""Template residue, filler, failure messages and script notices in short texts.

Placeholders are found by a grammar for each kind of delimiter. Delimiters that also serve in ordinary writing
(single braces, brackets and percent signs) need a name inside that templates use. Filler is found by its
vocabulary and by repetition, messages and notices by their wording when they make up a whole segment of the
text (between ends, bars, dashes or sentence ends), so a title that only speaks of one is none.

A hit is discounted when it is quoted, in code (fenced or indented blocks, ticks, ``<pre>``, ``<code>``), or when
the words next to it speak about it, as tutorials do, and the rest is the larger part of the text by density.

All of it is built-in expressions on columns: no Python, no shuffle.

Defined cases: null, empty and blank texts hold no residue; letter case, white space and curly quotes don't
matter; texts, placeholders, code and messages may have any length.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelode.functions.text import bind

#: Names that templates give their slots, fixed values; spaces stand for any of ' ', '_', '.', '-' or nothing.
SLOT_NAMES = (
    "site name", "site title", "site", "brand", "brand name", "business", "business name", "company", "company name", "product", "product name", "product title",
    "first name", "last name", "user name", "customer name", "name", "title", "page", "page title", "page name", "post title", "post excerpt", "post", "excerpt", "seo title", "seo description",
    "meta title", "meta description", "description", "headline", "heading", "sub heading", "tagline", "slogan", "summary", "text", "content", "body", "keyword", "keywords", "city", "town", "region", "location",
    "category", "tag", "year", "month", "date", "price", "author", "domain", "url", "link", "service", "service name", "phone", "email", "address", "store name", "shop name", "template", "variable", "placeholder",
)

#: Words of filler text that ordinary texts of the languages at hand don't string together, fixed values.
FILLER_WORDS = (
    "lorem", "ipsum", "dolor", "sit", "amet", "consectetur", "adipiscing", "elit", "eiusmod", "tempor", "incididunt", "labore", "dolore", "magna", "aliqua", "enim", "minim", "veniam", "quis", "nostrud",
    "exercitation", "ullamco", "laboris", "nisi", "aliquip", "commodo", "consequat", "duis", "aute", "irure", "reprehenderit", "voluptate", "velit", "cillum", "fugiat", "pariatur", "excepteur", "sint",
    "occaecat", "cupidatat", "proident", "sunt", "culpa", "officia", "deserunt", "mollit", "laborum",
)

_SLOT = "(?:" + "|".join(sorted((n.replace(" ", "[ _.-]?") for n in SLOT_NAMES), key=len, reverse=True)) + ")"
_SLOT_SPACED = "(?:" + "|".join(sorted(SLOT_NAMES, key=len, reverse=True)) + ")"
#: An identifier that is no ordinary word: joined by underscore or dot, or in camel case.
_IDENTIFIER = r"(?:[a-z]\w*(?:[_.][a-z]\w*)+)"
_NAME = rf"\s?(?:{_SLOT}|{_IDENTIFIER})\s?"

#: A grammar for each pair of delimiters: from the opening one to the next closing one, however far that is and whatever is nested in between.
PLACEHOLDERS = (
    r"\{\{.*?\}\}",
    r"\{%.*?%\}",
    r"[$#]\{.*?\}",
    r"\{\$.+?\}",
    r"<%.*?%>",
    r"<\?(?:php|=).*?\?>",
    r"\[\[.+?\]\]",
    r"\[%.+?%\]",
    r"\*\|.+?\|\*",
    r"%%[^%\s](?:[^%]*[^%\s])?%%",
    r"@model\.\w[\w.]*",
    r"__[a-z][\w. ]*?__",
    rf"%{_NAME}%",
    rf"\{{{_NAME}\}}",
    r"\{\d{1,2}\}",
    rf"\[{_NAME}\]",
    r"\[object object\]",
    r"(?<![\w%])%(?:\d{1,2}\$)?[sd](?![\w%])",
)

_FILLER = "(?:" + "|".join(FILLER_WORDS) + ")"
FILLERS = (
    rf"(?<![“\"«„'`])\b{_FILLER}(?:[ ,.;]+{_FILLER}){{2,}}\b",
    r"(?<![“\"«„'`])\blorem ipsum\b(?![”\"»“'`])(?! &)",
    rf"^[^\w]*{_FILLER}(?:[ ,.;]+{_FILLER})*[.]?(?:$| [|–-] )",
    r"\b(asdf|qwerty|lipsum|blah|foo bar|abc|xxx|foo|bar|baz|test|text|dummy|sample)(?:[ ,]+\1\b)+",
    r"\b(\p{L}{2,})(?:[ ,]+\1\b){2,}",
    r"\bxxx+ [^|]+? xxx+\b",
    r"\btest test\b",
)

#: What an editor was to fill in.
_THING = rf"(?:{_SLOT}|copy|caption|intro|page (?:text|description))"
PROMPTS = (
    rf"your (?:own )?{_THING}(?: (?:goes )?here)?",
    rf"your {_THING} (?:goes )?here",
    rf"\[your [^\]]+\]",
    rf"\[(?:insert|add|enter|type) [^\]]+\]",
    rf"insert (?:your |the |a )?{_THING}(?: here)?",
    rf"(?:enter|type|write|add) (?:your |the |a |an ){_THING}(?: (?:here|for this page))?",
    rf"(?:enter|type|write|add|put) {_THING} (?:here|for this page)",
    rf"(?:sample |example )?{_THING} ?[-–] ?(?:replace|change|edit|update) before (?:launch|publishing|going live)",
    rf"hier (?:bitte )?(?:ihren? |den |die |das )?{_THING} (?:eintragen|einfügen|eingeben)",
    rf"votre {_THING} ici",
    rf"(?:insérez|saisissez|ajoutez) (?:votre |le |la |un |une ){_THING}(?: ici)?",
    rf"(?:escriba|inserte|añada|escribe) aquí (?:su|tu|el|la) {_THING}",
    rf"(?:su|tu) {_THING} aquí",
    rf"default {_THING}",
    rf"dummy {_THING}",
    rf"(?:this is a )?placeholder {_THING}",
    rf"change me(?:: ?{_THING})?",
    rf"(?:todo|tbd|fixme|xxx)\b:? ?(?:write |add |fill in )?(?:{_THING})?",
    rf"new page ?[-–] ?{_THING} to follow",
    rf"{_THING} goes here",
    rf"{_THING} to follow",
    r"untitled(?: (?:page|document|\d+))?",
    r"sample (?:page|text|title|description)",
    r"(?:hello world|coming soon|under construction)!?",
)

#: Values that a template printed instead of text.
_NOTHING = r"(?:undefined|null|nan|none|n/a|nil|\[object object\])"
NOTHINGS = (rf"{_NOTHING}(?: ?[|,/–-] ?{_NOTHING})*",)
REPEATED_NOTHING = rf"(?<![\p{{L}}\d])(undefined|null|nan|none|n/a|nil)(?: \| \1)?(?![\p{{L}}\d])(?: \p{{L}}{{1,6}}){{0,3}} \1(?: \| \1)?(?![\p{{L}}\d])"

_CODE = r"(?:[45]\d\d)"
MESSAGES = (
    rf"(?:(?:http|error|erreur|fehler|status)(?: code)?[ :#]*)?{_CODE}",
    rf"(?:(?:http|error|erreur|fehler)[ :#]*)?{_CODE}[ :–-]*(?:error|not found|forbidden|gone|unauthorized|bad (?:gateway|request)|internal server error|service (?:temporarily )?unavailable|gateway time-?out|request time-?out|too many requests|page not found)",
    rf"(?:http|error|erreur|fehler)[ :#]*{_CODE} ?[:–-] ?[^|]{{3,}}?",
    r"(?:the )?(?:requested )?(?:page|url|file|site|resource)(?: you requested)? (?:was |is |could |can )?(?:not|n't)(?: be)? ?(?:found|available|exist)",
    r"(?:oops|sorry|whoops)?[!,.]? ?(?:that|this|the) page (?:can't|cannot|could not|couldn't) be found",
    r"page (?:not found|does not exist|doesn't exist|no longer exists|unavailable)",
    r"not found|forbidden|bad gateway|bad request|gateway time-?out|internal server error|service (?:temporarily )?unavailable|unauthorized",
    r"(?:die )?seite (?:wurde )?nicht gefunden|(?:die )?seite existiert nicht(?: mehr)?|seite nicht verfügbar|zugriff verweigert|interner serverfehler",
    r"page (?:introuvable|non trouvée)|(?:cette|la) page n'existe (?:plus|pas)|accès (?:refusé|interdit)|le serveur ne répond pas|erreur (?:interne )?du serveur",
    r"(?:la )?página no (?:encontrada|existe|disponible)|no existe la página|acceso denegado|error (?:interno )?del servidor",
    r"(?:de )?pagina niet gevonden|pagina non trovata|página não encontrada",
    r"(?:お探しの)?ページが見つかりません(?:でした)?。?|页面(?:不存在|未找到)。?|找不到(?:该)?页面。?",
    r"access (?:is )?denied|permission denied|you (?:do not|don't) have permission[^|]{0,}?",
    r"(?:sorry, ?)?(?:we )?(?:couldn't|could not|can't|cannot) find (?:what you were looking for|(?:the|that|this) page[^|]{0,}?)",
    r"(?:oops[!,.]? ?)?something went wrong(?:[.!,]? ?(?:please )?try again(?: later)?)?|an? (?:unexpected |unknown )?error (?:has )?occurred[^|]{0,}?",
    r"this (?:page|site) (?:isn't|is not) (?:working|available)(?: right now)?",
    r"application error(?::[^|]{0,}?)?|runtime error|server error(?: in '/' application)?",
    r"error establishing a database connection|(?:my)?sql (?:syntax )?error(?: near line \d+)?|database error|could not connect to (?:the )?database",
    r"(?:warning|notice|fatal error|parse error|uncaught \w*error|deprecated|traceback)(?::| \() ?[^|]{3,}?",
    r"request (?:id )?[\w-]* ?(?:was |has been )?blocked|(?:you have been|your (?:ip|request) (?:was|has been)) blocked",
    r"(?:this )?(?:account|site|website) (?:has been |is )?suspended",
    r"(?:this )?domain (?:name )?(?:is |has been )?(?:parked|for sale|expired)",
    r"(?:this |the |our )?(?:site|website|page) (?:is )?(?:temporarily |currently )?(?:down|offline|unavailable|under|closed)(?: (?:for|due to))? ?(?:scheduled |planned )?(?:maintenance|construction)?",
    r"(?:we are |down |currently )?(?:down|closed|under) (?:for )?maintenance|maintenance mode",
    r"(?:sitio|página|web) en (?:mantenimiento|construcción)|site en (?:maintenance|construction)|(?:seite|website) (?:im aufbau|in wartung)",
    r"wartungsarbeiten(?: ?[-–,:] ?[^|]{0,}?)?",
    r"(?:your |the )?session (?:has )?(?:expired|timed out)",
    r"index of /\S*",
    r"(?:please )?(?:verify|confirm|prove) (?:that )?you(?:'re| are) (?:a )?(?:human|not a robot)(?: to (?:proceed|continue))?",
    r"(?:checking|verifying) (?:your browser|if the site connection is secure)(?: before[^|]{0,}?)?",
    r"just a moment(?: please wait)?(?= ?[.…])|one moment, please ?(?:\.{2,3}|…)?|please wait ?(?:\.{2,3}|…)?|loading ?(?:\.{2,3}|…)",
    r"attention required!?|(?:ddos|bot) protection by[^|]{0,}?|are you a robot\??|captcha(?: required)?|too many requests|rate limited|quota exceeded",
)

_SCRIPT = r"(?:java ?script|js|scripts?|scripting)"
NOTICES = (
    rf"(?:please |you need to |you must |to [^|]{{3,}}?, ?)?(?:enable|activate|allow|turn on|switch on|unblock) (?:cookies and )?{_SCRIPT}(?:(?: in| for) (?:your|this) (?:browser|settings|site))?(?: ?(?:,|and|or|to|then|for) [^|]{{3,}}?)?",
    rf"(?:please )?(?:turn|switch) {_SCRIPT} (?:back )?on(?: ?(?:,|and|to) [^|]{{3,}}?)?",
    rf"[^|.]*\b(?:requires?|needs?) {_SCRIPT}(?: to [^|]{{3,}}?)?",
    rf"{_SCRIPT} (?:is|are|seems?(?: to be)?|must be|needs? to be|has to be) (?:currently )?(?:disabled|required|needed|off|turned off|switched off|blocked|enabled|on|turned on|switched on)(?: (?:in|for|to|on|by)\b[^|]{{0,}}?)?",
    rf"{_SCRIPT} (?:disabled|required|needed)",
    rf"(?:your|this) browser (?:does not|doesn't|is not|cannot|can't) (?:support|run|execute|allow)(?:ing)? {_SCRIPT}",
    rf"[^|]{{0,}}?\b(?:unless|without|until) {_SCRIPT} (?:is|are|being)? ?(?:switched on|turned on|enabled|on|active)",
    rf"[^|]{{0,}}?\({_SCRIPT} (?:must be|is|are) (?:on|required|enabled|needed)\)",
    rf"(?:bitte )?(?:aktivieren|schalten|erlauben) sie (?:bitte )?{_SCRIPT}[^|]{{0,}}?|(?:bitte )?{_SCRIPT} (?:aktivieren|einschalten|erlauben)[^|]{{0,}}?|{_SCRIPT} (?:ist|wird) (?:deaktiviert|benötigt|erforderlich|ausgeschaltet)[^|]{{0,}}?",
    rf"(?:veuillez |merci d['’])?(?:activer|activez|autoriser) {_SCRIPT}[^|]{{0,}}?|{_SCRIPT} (?:est|doit être) (?:désactivé|requis|nécessaire|activé)[^|]{{0,}}?",
    rf"(?:por favor,? )?(?:active|activa|habilite|habilita|active el|activar) {_SCRIPT}[^|]{{0,}}?|{_SCRIPT} (?:está|debe estar) (?:desactivado|deshabilitado|activado|habilitado)[^|]{{0,}}?|(?:se requiere|requiere|necesita) {_SCRIPT}[^|]{{0,}}?",
    rf"(?:schakel|zet) {_SCRIPT} (?:in|aan)[^|]{{0,}}?|(?:abilita|attiva) {_SCRIPT}[^|]{{0,}}?|(?:ative|habilite) o {_SCRIPT}[^|]{{0,}}?",
    rf"{_SCRIPT}(?:を有効にして(?:ください)?|が(?:無効|必要)です?)[^|]{{0,}}?|请?(?:启用|开启) ?{_SCRIPT}[^|]{{0,}}?",
    r"\[?noscript\]?",
)

#: Words one of which every message, prompt and filler holds, in lower case; texts without them skip the patterns.
MESSAGE_WORDS = (
    "found", "avail", "exist", "forbidden", "bad ", "gateway", "time", "error", "fehler", "erreur", "unauthorized", "nicht", "zugriff", "introuvable", "trouvée", "accès", "serveur", "encontrada", "disponible", "acceso",
    "gevonden", "trovata", "页", "ページ", "denied", "permission", "find", "wrong", "working", "database", "warning", "notice", "uncaught", "deprecated", "traceback", "blocked", "suspended", "domain", "maintenance", "down",
    "offline", "closed", "construc", "mantenimiento", "aufbau", "wartung", "expired", "timed out", "index of", "robot", "human", "browser", "secure", "moment", "wait", "loading", "attention", "protection", "captcha", "too many", "rate limited", "quota", "under",
)
PROMPT_WORDS = (
    "your", "[", "insert", "enter", "type", "write", "add", "put", "replace", "change", "edit", "update", "hier", "votre", "insérez", "saisissez", "ajoutez", "aquí", "default", "dummy", "placeholder", "todo", "tbd", "fixme", "xxx",
    "new page", "here", "follow", "untitled", "sample", "hello", "coming soon", "construction",
)

#: Words that, right before or after a placeholder, speak about it.
_ABOUT_BEFORE = r"(?:stray|unfilled|unrendered|literal|raw|leftover|left-over|token|tokens|placeholder|placeholders|variable|variables|syntax|called|named|like|write|typing|typed)"
_ABOUT_AFTER = r"(?:tokens?|tags?|placeholders?|variables?|syntax|markers?|costs? you|means?)"

_BEFORE = r"(?:^|[|–—-] |[.!?…)] |。)"
_AFTER = r"(?: ?\((?:ref|id|code)\.? [\w-]+\))?[.!…]*(?:$| [|–—-] |[.!…] )"
#: A residue may run into a sentence without a mark between them.
_SENTENCE = r"(?: ?\((?:ref|id|code)\.? [\w-]+\))?(?= (?-i:[\p{Lu}\d¿])[^|]{30,}[.?!]$)"


def _whole(patterns: tuple[str, ...]) -> str:
    """Any of the patterns as a whole segment."""
    return f"(?iu){_BEFORE}(?:{'|'.join(patterns)})(?:{_AFTER}|{_SENTENCE})"


_PLACEHOLDER = f"(?ius)(?:{'|'.join(PLACEHOLDERS)})"
#: What is quoted as code: fenced and indented blocks of a text with lines, ticks and elements.
_CODE_BLOCKS = r"(?is)```.*?(?:```|$)|~~~.*?(?:~~~|$)|<(pre|code|kbd|samp)\b[^>]*>.*?</\1>|`[^`]+`|(?<=[\r\n])(?: {4}|\t)[^\r\n]*"
_SPOKEN_OF = rf"(?ius)\b{_ABOUT_BEFORE} [“\"'«„]?(?:{'|'.join(PLACEHOLDERS)})|(?:{'|'.join(PLACEHOLDERS)})[”\"'»“]? {_ABOUT_AFTER}\b"
#: A slot name between doubled spaces, as underscores leave it that a site turned into spaces.
_GHOST = rf"(?iu)(?:^ {{2,3}}|\S {{3,4}}){_SLOT_SPACED.replace(' ', '[ .]?')}(?: {{2,3}}$| {{3,4}}\S)"


def normal(text: Column) -> Column:
    """White space runs as one space, straight apostrophes, trimmed."""
    return F.trim(F.regexp_replace(F.translate(text, "’‘", "''"), r"[\s  -​　﻿]+", " "))


def residue_kind(text: Column) -> Column:
    """placeholder, filler, message or notice; null if the text holds none."""
    with_normal = bind(text, lambda raw: F.struct(raw.alias("raw"), normal(raw).alias("t")))
    return bind(with_normal, lambda x: bind(F.struct(x["raw"].alias("raw"), x["t"].alias("t"), F.lower(x["t"]).alias("l")), _kind))


def _holds(text: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, (text.contains(w) for w in words))


def _unfilled(x: Column) -> Column:
    """Whether placeholders stand in the text that are neither code nor spoken of, or are most of it although they are spoken of."""

    def of(code: Column) -> Column:
        spoken = F.regexp_replace(code, _SPOKEN_OF, " ")
        density = F.length(spoken) < F.length(x["t"]) / 2
        return code.rlike(_PLACEHOLDER) & (spoken.rlike(_PLACEHOLDER) | density)

    return bind(normal(F.regexp_replace(x["raw"], _CODE_BLOCKS, " ")), of)


def _kind(x: Column) -> Column:
    text, t, low = x["raw"], x["t"], x["l"]
    # No placeholder is without such a mark, and no notice without such a word.
    marked, scripted = t.rlike(r"[{\[<%*@_]"), low.rlike("script|js")
    run = low.rlike(f"(?u)(?:{'|'.join(FILLERS[:3])})")
    filler = F.lit(False)
    for pattern in FILLERS[3:]:
        filler = filler | low.rlike(f"(?u){pattern}")
    nothing = _holds(low, ("undefined", "null", "nan", "none", "n/a", "nil", "[object")) & (t.rlike(_whole(NOTHINGS)) | low.rlike(f"(?u){REPEATED_NOTHING}"))
    return (
        F.when(marked & _unfilled(x), "placeholder")
        .when(text.rlike(_GHOST), "placeholder")
        .when(nothing, "placeholder")
        .when((_holds(low, FILLER_WORDS) & run) | filler | (_holds(low, PROMPT_WORDS) & t.rlike(_whole(PROMPTS))), "filler")
        .when(scripted & t.rlike(_whole(NOTICES)), "notice")
        .when((_holds(low, MESSAGE_WORDS) | t.rlike("[45][0-9][0-9]")) & t.rlike(_whole(MESSAGES)), "message")
    )


def with_residue(df: DataFrame, cols: list[str]) -> DataFrame:
    """``df`` with ``residue_<column>`` for each of the columns."""
    return df.withColumns({f"residue_{c}": residue_kind(F.col(c)) for c in cols})


def without_residue(df: DataFrame, cols: list[str]) -> DataFrame:
    """The rows none of whose columns holds residue."""
    keep = F.lit(True)
    for c in cols:
        keep = keep & residue_kind(F.col(c)).isNull()
    return df.where(keep)
