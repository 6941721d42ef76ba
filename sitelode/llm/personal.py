"""Personal information in free text: candidates, weak votes, an estimate of their reliability, and a span classifier.

1. Grammars propose spans of each kind (email, phone, id_number, address, person). They are wide; several
   proposals are wrong.
2. Labelers vote on each span, for it (1), against it (-1) or not at all (0): regular expressions of strict
   forms, a gazetteer of names, affixes learned from the gazetteer, the words before and after, the place in a
   signature or a link, units, samples and numbers of other kinds. A span's votes make up its pattern.
3. Patterns are counted over all documents. There are at most 3^labelers of a kind, so the counts are small.
   Expectation maximisation on them estimates how reliable each labeler is and how likely each pattern's spans
   are true; no labelled data is used. A prior that holds a tenth of the data's weight says what a vote means, so
   the two classes can't change places, and few spans decide nothing by themselves.
4. A logistic classifier over the span itself and its surroundings (shapes, affixes, neighbouring words, line
   ends; not the votes) is trained on the estimate, on all spans. The evidence of both decides each span: a context
   that goes with false candidates speaks against a doubtful one.

Candidates are found in one pass and written to the shared folder; counting, training and deciding read that
table, whose rows are some numbers a span. Patterns come to the driver, and up to ``HELD_SPANS`` spans for training;
where there are more, the executors sum each round's gradient over all of them.
:func:`redact` decides again where the text is, so no text is shuffled.

Defined cases: null, empty and blank texts have no spans; positions are code points; texts are read whole; a
repeated text has its spans under each id; spans of one text don't overlap (of persons that do the first and longer
one counts); with an empty gazetteer names are found by their surroundings alone; a gazetteer above ``MOST_NAMES``
is not sent to the tasks: its names, and the affixes counted over all of them, are joined to the words of the texts.
"""

from __future__ import annotations

import re
from bisect import bisect
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitelode.session import cut

KINDS = ("email", "id_number", "address", "phone", "person")
#: Gazetteers up to this size (some 10 MB) are sent to the executors.
MOST_NAMES = 200_000
#: Up to so many spans (60 MB) the driver trains the classifier; beyond, the executors sum the gradients.
HELD_SPANS = 2_000_000

_L = "A-Za-zÀ-ÖØ-öø-žȘ-ț"
_UP = "A-ZÀ-ÖØ-Þ"
_LOW = "a-zß-öø-ÿ"

# -- email ---------------------------------------------------------------------------------------
_LABEL = r"[a-z0-9](?:[a-z0-9-]*[a-z0-9])?"
_AT_WORD = r"[\[({<] ?(?:at|AT|ät|arroba|chez) ?[\])}>]"
_AT = rf"(?: ?[@＠] ?| ?{_AT_WORD} ?)"
#: What every address without the sign holds.
_AT_MARK = re.compile(rf"{_AT_WORD}| at ", re.I)
_DOT = r"(?:\.| ?[\[(] ?(?:dot|punkt|point|punto) ?[\])] ?)"
EMAIL = re.compile(rf"(?<![a-z0-9._%+-])[a-z0-9](?:[a-z0-9._%+-]*[a-z0-9_+-])?(?:{_AT}{_LABEL}(?:{_DOT}{_LABEL})*{_DOT}[a-z]{{2,24}}| at {_LABEL}(?:(?:\.| dot ){_LABEL})* dot [a-z]{{2,24}})(?![a-z0-9])", re.I)

# -- identity, tax and insurance numbers ----------------------------------------------------------
ID_LABEL = (
    r"SSN|ITIN|TIN|social security(?: number| no\.?)?|NINO|NI (?:number|no\.?)|national insurance(?: number| no\.?)?|passport(?: (?:number|no\.?|nr\.?|#))?|Reisepass(?:nummer|[ -]?Nr\.?)?|"
    r"Personalausweis(?:nummer|[ -]?Nr\.?)?|Ausweis(?:nummer|[ -]?Nr\.?)|(?:ID|identity) card(?: (?:number|no\.?))?|(?:driver'?s?|driving) licen[cs]e(?: (?:number|no\.?))?|Führerschein(?:nummer|[ -]?Nr\.?)?|"
    r"Steuer-?(?:ID|Identifikationsnummer|nummer|Nr\.?)|Sozialversicherungsnummer|(?:tax|taxpayer|fiscal) (?:number|ID|no\.?|code)|DNI|NIE|NIF|NIR|n° de sécurité sociale|numéro (?:de sécurité sociale|fiscal)|sécurité sociale|"
    r"(?:carte d'identité|passeport)(?: n°)?|(?:número de )?(?:seguridad social|pasaporte)|health insurance (?:number|no\.?)|insurance (?:number|no\.?)|身份证号?码?|护照号?码?|パスポート番号|旅券番号|マイナンバー|社保号"
)
ID_VALUE = (
    r"\d{3}-\d{2}-\d{4}|[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-Z](?![a-z])|\d \d{2} \d{2} \d{2} \d{3} \d{3}(?: \d{2}(?!\d))?|\d{2} \d{3} \d{3} \d{3}|\d{2,3}/\d{3}/\d{4,5}|\d{2}-\d{4}-\d{3}-[A-Z]|[A-Z]{4}-\d{6}-[A-Z]\d|"
    r"[XYZ]-?\d{7}-?[A-Z]|\d{8}-?[A-Z]|[A-Z]{1,3}[ -]?\d{6,9}|\d{9,13}|\d{3} \d{2} \d{4}"
)
ID = re.compile(rf"(?<![{_L}])(?P<label>{ID_LABEL})(?P<sep>[ :=#№.：]{{0,4}}(?:n[°º]|no\.?|nr\.?)?[ :=#：]{{0,3}})(?P<value>{ID_VALUE}|[A-Z\d][A-Z\d/-]{{4,16}}\d[A-Z]?)", re.I)
_ID_STRICT = re.compile(rf"(?:{ID_VALUE})\Z", re.I)

# -- addresses -------------------------------------------------------------------------------------
_STREET = r"(?:Street|St\.?|Lane|Ln\.?|Road|Rd\.?|Avenue|Ave\.?|Court|Ct\.?|Row|Close|Terrace|Terr\.?|Way|Drive|Dr\.?|Place|Pl\.?|Square|Sq\.?|Boulevard|Blvd\.?|Crescent|Gardens|Hill|Mews|Walk|Parade|Quay|Yard|Alley|Grove|Rise|View|Wharf|Highway|Parkway|Pkwy\.?)"
_PLACE_WORD = r"(?:Bay|Flats|Cross|Sands|Green|Hill|Hills|Heath|Park|Falls|Springs|City|Town|Vale|Wood|Woods|Wells|Beach|Harbor|Harbour|Point|Ridge|Grove|Lake|Lakes|Mills|Bridge|Ford|Haven|Island|Valley|Junction|Common|Moor|Gate|End|Rock|Creek|Port|Hollow|Landing|Station|Abbey|Market|Regis|Spa|Head|Mouth|Bluff|Heights|Village|Keys|Shore|Shores|Fields|Meadows|Quay|Tarn|Fell|Dale|Glen|Firth|Marsh)"
_WORD = rf"[{_UP}][{_LOW}'’]+"
_TOWN = rf"(?:(?:St\.?|Saint|New|North|South|East|West|Upper|Lower|Great|Little|Old|Port|Mount|Fort|Lake|El|La|Los|San|Santa) )?{_WORD}(?:-{_WORD}|-(?:on|upon|by|under|le|la|in|the)-{_WORD})*(?: {_PLACE_WORD}(?![{_LOW}]))?"
_NL = r"(?:,? ?\r?\n|\r)"
_COMMA = rf"(?:, |{_NL})"
_UK_CODE = r"[A-Z]{1,2}\d{1,2}[A-Z]? \d[A-Z]{2}"
_US_CODE = r"[A-Z]{2} \d{5}(?:-\d{4})?"
_ENGLISH = rf"(?:(?:Flat|Apartment|Apt\.?|Unit|Suite|Floor|Room) \d+\w?{_COMMA}|{_WORD}(?: {_WORD})? (?:House|Building|Court|Lodge|Cottage|Mill){_COMMA})?(?<![\d.,-])\d{{1,5}}[a-zA-Z]?(?:-\d{{1,4}})? (?:[NSEW]\.? |North |South |East |West )?{_WORD}(?: {_WORD})?? {_STREET}(?:,? (?:Suite|Ste\.?|Apt\.?|Apartment|Unit|Floor|Room|#) ?#?\w{{1,5}})?{_COMMA}{_TOWN}(?:(?:,? |{_COMMA})(?:{_UK_CODE}|{_US_CODE})(?![A-Za-z0-9]))?"
_CITY = rf"{_WORD}(?:[- ](?:sur|sous|en|le|la|les|lès|de|del|des|du|am|an der|an|im|in der|ob der|bei|do|da)[- ]{_WORD}|-{_WORD})*"
_GERMAN = rf"(?<![{_L}])(?:(?:Am|An der|Im|In der|Auf der|Zum|Zur|Alter?|Alte|Neue[rs]?|Obere|Untere|Große|Kleine|{_WORD}) )?{_WORD}(?:str\.|-{_WORD})? ?\d{{1,4}} ?[a-z]?(?![{_L}])(?:, | ?[-–] |{_NL}){{1}}(?:D-)?\d{{5}} {_CITY}"
_FRENCH = rf"(?<![\d.,-])\d{{1,4}}(?: ?(?:bis|ter|quater|[A-D]))?,? (?:rue|avenue|av\.|boulevard|bd|place|chemin|allée|impasse|quai|cours|route|square|passage|ruelle|sentier|esplanade)(?: [{_L}'’-]+){{1,6}}{_COMMA}(?:F-)?\d{{5}} {_CITY}"
_SPANISH = rf"(?<![{_L}])(?:Calle|C/|Avenida|Avda\.?|Av\.|Plaza|Pza\.?|Paseo|Pº|Camino|Carretera|Ctra\.?|Ronda|Travesía|Callejón|Glorieta|Rambla)(?: [{_L}'’-]+){{1,6}},? ?(?:n\.?[º°o]\.?|núm\.?|número|#)? ?\d{{1,4}}(?:,? (?:bajo|ático|entlo\.?|\d{{1,2}}\.?[ºª°]?(?: ?(?:izq|dcha|[A-Z])\.?)?))?{_COMMA}\d{{5}} {_CITY}(?: {_WORD})?"
ADDRESS = re.compile(rf"(?P<spanish>{_SPANISH})|(?P<french>{_FRENCH})|(?P<english>{_ENGLISH})|(?P<german>{_GERMAN})")

# -- phones ------------------------------------------------------------------------------------------
_S = r"[ .\-‐‑–]"
_PHONES = {
    "abroad": rf"(?:[+＋]|(?<!\d)00)(?:1{_S}?\(?\d{{3}}\)?{_S}?\d{{3}}{_S}?\d{{4}}|44 ?(?:\(0\) ?)?(?:\d{{2}} ?\d{{4}} ?\d{{4}}|\d{{3}} ?\d{{3}} ?\d{{4}}|\d{{4}} ?\d{{6}}|\d{{4}} ?\d{{3}} ?\d{{3}})|33 ?(?:\(0\) ?)?\d(?:{_S}?\d{{2}}){{4}}|[2-9]\d{{1,2}}{_S}?(?:\(0\) ?)?\d{{1,5}}{_S}?\d{{2,8}}(?:{_S}\d{{2,5}}){{0,3}})",
    "bracket": rf"\(0?\d{{2,5}}\){_S}?\d{{3,8}}(?:{_S}\d{{3,5}})?",
    "american": rf"(?:1{_S})?\d{{3}}(?P<s>[ .\-‑–])\d{{3}}(?P=s)\d{{4}}",
    "national": rf"0\d{{2}} \d{{4}} \d{{4}}|0\d{{4}} \d{{6}}|0\d{{3,4}} \d{{3}} \d{{3,4}}|0\d{{1,4}}/\d{{4,9}}|0\d{{2,4}}[ -]\d{{4,8}}(?:-\d{{1,4}})?",
    "pairs": r"0[1-9](?:[ .]\d{2}){4}|0[1-9](?:-\d{2}){4}",
}
PHONE = re.compile(r"(?<![\dA-Za-z,/#&=_-])(?<!\d\.)(?:" + "|".join(f"(?P<{k}>{v})" for k, v in _PHONES.items()) + r")(?![\d/]|[.,‑-]\d)")

#: Words right before a phone number, or numbers of other kinds, that speak for or against it.
_PHONE_CUE = re.compile(r"(?:phone|tel|tél|telefon|teléfono|téléphone|mobile|mobil|móvil|portable|cell|fax|call|text|ring|reach|dial|whatsapp|sms|hotline|rufen sie|llame al|llámenos al|appelez(?: le)?|we are on|contact|kontakt|tel:|电话|電話|手机|携帯)[^\w\n]{0,6}(?:us )?(?:at |on |le |al |us on )?$", re.I)
_NOT_PHONE = re.compile(r"(?:\b(?:order|pedido|commande|rechnung|invoice|sku|gtin|ean|isbn(?:-\w+)?|batch|voucher|booking ref|ref|reference|ticket|version|coordinates|impressions|clicks|port|serial|tracking|parcel|item|article|id|ssn|tax number|steuer-id|sociale|insurance|card|no\.|nr\.|n°|№)[ :=#]{0,3}(?:no\.?|nr\.?|n°|number|code)?[ :=#]{0,3}|\d )$", re.I)

# -- persons -----------------------------------------------------------------------------------------
WORD = re.compile(rf"[{_L}]{{3,}}")
_PARTICLE = r"(?:von der|van der|van den|de la|de las|de los|von|van|de|del|della|der|di|da|du|den|ter|ten|zu|zum|af|av|bin|ibn|al|el|le|la|dos|das|do|st\.?)"
_FULL = re.compile(rf"(?: ([{_L}])\.)?(?: {_PARTICLE})? ((?:[dDlLoO]['’])?[{_L}]{{2,}})(?:-([{_L}]{{2,}}))?(?![{_L}])", re.I)
_REVERSED = re.compile(rf"(?:-([{_L}]{{2,}}))?, ([{_L}]{{2,}})(?: ([{_L}])\.)?(?![{_L}])")
_INITIAL = re.compile(rf"(?<![{_L}.])([{_L}])\.(?: ?[{_UP}]\.)? (?:{_PARTICLE} )?$", re.I)
_DOUBLE = re.compile(rf"-([{_L}]{{2,}})(?![{_L}])")

_TITLE = re.compile(r"(?:\b(?:dr|prof|mr|mrs|ms|miss|sr|sra|srta|don|doña|herr|herrn|frau|mme|mlle|m|madame|monsieur|señor|señora)\.?|博士|教授) $", re.I)
_GREETING = re.compile(r"(?:\b(?:dear|hi|hello|hey|thanks|thank you|cheers|hallo|liebe|lieber|guten tag|bonjour|cher|chère|salut|merci|hola|querido|querida|estimado|estimada|gracias|ciao),? |亲爱的|你好，?)$", re.I)
_ROLE = re.compile(
    r"(?:(?:author|contact|contacto|ansprechpartner(?:in)?|responsable|founder|owner|guide|[a-z]+ on duty|cc|bcc|from|attn|by|manager|editor|signed off by|reviewed by|written by|inhaber(?:in)? ist|geschäftsführer(?:in)?|guiado por|guidée avec|par|por|von|with|ask|says|met|told|thanks to|our [a-z]+|担当|担当者|联系人|作者|负责人|著者)\s?[:：]? ?)$", re.I
)
_CLOSING = re.compile(r"(?:(?:regards|wishes|sincerely|cheers|thanks|yours|grüßen|grüße|gruß|cordialement|salutations|saludo|saludos|atentamente|敬具|此致),?\s*\n\s*|\n--\s*\n\s*)$", re.I)
_SAID_AFTER = re.compile(r"^(?:,|\.)?\s?(?:wrote|said|says|told|opened|has|had|hat|revisó|a relu|reviewed|signed|will|for the|after the|about the|asks|asked|called|founded|\||;|，|より|さん|様|先生|女士)", re.I)
_NO_PERSON_BEFORE = re.compile(r"(?:\b(?:the|der|die|das|la|le|el|los|les) |\d |@|#|＠)$", re.I)
_NO_PERSON_AFTER = re.compile(rf"^(?: ?(?:&|and|und|et|y) (?:Sons?|Co|Daughters?|Söhne|Fils|Hijos|Partners?)| (?:Award|Prize|Medal|Bridge|Street|St\.|Lane|Road|Rd|Avenue|Ave|Court|Row|Close|Terrace|Way|House|Square|Hall|Park|Hill|Tower|Centre|Center|School|University|College|Museum|Gallery|Library|Theatre|Station|Foundation|Trust|Trophy|Cup|Ltd|Inc|LLC|GmbH|AG|Optics|Carpets|Tailors|Bakery|Tours|Walks|Spa|Dental|Clinic|Studio|Brewery|Roastery|Market|Nursery|Garden|Stables|Kayak|Cycles|Plumbing|Roofing|Workshop|Pottery|Ferry|Bindery|Aquarium|Dairy|Smokehouse|Observatory|Lodge|Cellar|Tutors|Hostel|[A-Z][a-z]+s? (?:Award|Prize|Bridge|rank))\b|[@＠]|\.[a-z]|_)")


class Gazetteer:
    """Given and family names, and the beginnings and ends that they are made of."""

    #: An affix counts if so many names have it.
    LEAST = 3

    def __init__(self, names: list[tuple[str, str]]) -> None:
        self.parts = {"given": set(), "family": set()}
        for name, part in names:
            if name:
                self.parts["given" if part == "given" else "family"].add(name.casefold())
        self.affixes = {}
        for part, own in self.parts.items():
            begins, ends = Counter(), Counter()
            for n in own:
                for i in range(3, len(n) - 1):
                    begins[n[:i]] += 1
                    ends[n[i:]] += 1
            self.affixes[part] = ({b for b, c in begins.items() if c >= self.LEAST}, {e for e, c in ends.items() if c >= self.LEAST})
        self.known: dict[str, int] = {}
        #: Words that are no names, for sets of words to be cut down at once.
        self.no: set[str] = set()
        #: Words that a join told about, by case-folded word: the bits of :meth:`kind`.
        self.told: dict[str, int] = {}

    def tell(self, listed: dict[str, int]) -> None:
        """Takes the known words of one text from a join."""
        self.told = listed
        self.known.clear()
        self.no.clear()

    def kind(self, word: str) -> int:
        """Bits: listed as given 1, as family 2, made like given 4, like family 8."""
        got = self.known.get(word)
        if got is None:
            w = word.casefold()
            got = (w in self.parts["given"]) + 2 * (w in self.parts["family"]) | self.told.get(w, 0)
            for part, bit in (("given", 4), ("family", 8)):
                begins, ends = self.affixes[part]
                if any(w[:i] in begins and w[i:] in ends for i in range(3, len(w) - 1)):
                    got |= bit
            if len(self.known) > 500_000:
                self.known.clear()
                self.no.clear()
            self.known[word] = got
            if not got:
                self.no.add(word)
        return got


GIVEN, FAMILY = 1 | 4, 2 | 8
#: Labelers by kind, in the order of their votes.
LABELERS = {
    "email": ("form", "cue", "domain", "sample", "joined"),
    "id_number": ("label", "form", "context", "value"),
    "address": ("number", "code", "cue", "line", "against"),
    "phone": ("form", "cue", "against", "signature", "shape"),
    "person": ("listed", "made", "before", "after", "against", "case"),
}
FORMS = {"email": ("at", "spelled"), "id_number": ("strict", "loose"), "address": ("english", "german", "french", "spanish"), "phone": tuple(_PHONES), "person": ("full", "reversed", "initial", "given", "family", "cued", "native")}

_MAIL_CUE = re.compile(r"(?:e-?mail|mail|mailto:|write to|contact|kontakt|correo|courriel|écrivez à|escriba a|bitte an|send|邮箱|メール|reach us at|\|| /|\()\W{0,3}$", re.I)
_PLACE_CUE = re.compile(r"(?:address|adresse|dirección|find us at|find us|visit us at|moved to|parcels go to|ship to|located at|office at|sie finden uns|unsere adresse|nous sommes au|estamos en|住所|地址)\W{0,3}$", re.I)
#: A place that is spoken of, or a number that is none of a house.
_NO_PLACE = re.compile(r"(?:\b(?:corner of|between|near|along|route|line|bus|tram|platform|gate|version|chapter|page|figure|table|since|until|in|from|order|lot|invoice|ticket|top|best|about|photo)|[#№$€£%/])\s?$", re.I)
_UNIT_AFTER = re.compile(r"^\s?(?:%|°|€|\$|£|(?:eur|euros?|usd|gbp|dollars?|km|miles?|kg|g|mb|gb|kb|px|ms|pages?|people|visitors|users|words|rows|items|pieces|percent|prozent|times|clicks|impressions)\b)", re.I)
_SAMPLE_BEFORE = re.compile(r"(?:(?<![.@/-])\b(?:e\.g\.|for example|example|sample|format|formatted as|looks like|such as|placeholder|dummy|template|field|fake|z\.b\.|par exemple|por ejemplo|beispiel)\W{0,4}(?:a |an |the )?)$", re.I)
_NO_PAPER = re.compile(r"\b(?:order|invoice|ticket|version|build|product|article|item|sku|batch|serial|tracking|booking|reference|bestellung|rechnung|commande|pedido)\W{0,3}$", re.I)
_NOBODY = frozenset(("user", "username", "yourname", "your.name", "your-name", "firstname.lastname", "name", "someone", "example", "xxx", "foo", "john.doe.example"))
#: Titles and greetings, roles before a colon, and closings before a line end, that stand right before a name.
_CUES = (
    ("dr prof mr mrs ms miss sr sra srta herr herrn frau mme mlle madame monsieur señor señora dear hello hallo liebe lieber bonjour hola estimado estimada querido querida", r"[.,]? "),
    ("author contact founder owner editor inhaber inhaberin ansprechpartner ansprechpartnerin responsable", r" ?[:：] ?"),
    ("regards sincerely grüßen cordialement saludos atentamente", r",?\s*\n\s*"),
)
#: Both letter cases are spelled out and every branch begins with a letter, which lets the search skip most places.
_CUED = re.compile(
    "(?:" + "|".join(w + end for words, end in _CUES for x in words.split() for w in (x, x.capitalize())) + r"|(?:signed off|reviewed|written) by )"
    rf"(?P<name>[{_UP}][{_LOW}'’]+(?: (?:(?:von|van|de|del|della|di|da|du|le|la) )?[{_UP}][{_LOW}'’]+){{0,2}})(?![{_L}])"
)
#: Words of three letters or more one of which stands in a text with such a cue, and the shorter ones.
_CUE_WORDS = frozenset(w for words, _ in _CUES for x in words.split() if len(x) > 2 for w in (x, x.capitalize())) | {"signed", "reviewed", "written"}
_SHORT_CUES = ("Dr", "Mr", "Ms", "Sr", "dr.", "mr.", "ms.", "sr.", "dr ", "mr ", "ms ", "sr ")
#: Family names that most Chinese names begin with, fixed values.
_SURNAMES = "王李张刘陈杨黄赵吴周徐孙马朱胡郭何高林罗郑梁谢宋唐许韩冯邓曹彭曾肖田董袁潘于蒋蔡余杜叶程苏魏吕丁任沈姚卢姜崔钟谭陆汪范金石廖贾夏韦付方白邹孟熊秦邱江尹薛闫段雷侯龙史陶黎贺顾毛郝龚邵万钱严覃武戴莫孔向汤"
_HAN = "一-龥々"
_NATIVE = re.compile(
    rf"(?:(?:联系人|负责人|作者|经办人|亲爱的)[:：]? ?(?P<zh1>[{_SURNAMES}][{_HAN}]{{1,2}})(?![{_HAN}]))|(?:(?<![{_HAN}])(?P<zh2>[{_SURNAMES}][{_HAN}]{{1,2}})(?=先生|女士|小姐))"
    rf"|(?:(?:担当者?|著者|責任者|代表)[:：] ?(?P<ja1>[{_HAN}]{{1,3}}[ 　]?[{_HAN}]{{1,3}})(?![{_HAN}部課係店]))|(?:(?<![{_HAN}ぁ-んァ-ヶ])(?P<ja2>[{_HAN}]{{2,4}}(?:[ 　][{_HAN}]{{1,3}})?)(?=さん|氏(?![{_HAN}])))"
    r"|(?P<ru1>[А-ЯЁ][а-яё]+(?: [А-ЯЁ][а-яё]+)? [А-ЯЁ][а-яё]+(?:ович|евич|овна|евна|ична)(?: [А-ЯЁ][а-яё]+)?)|(?:(?:Уважаем(?:ый|ая)|[Гг]осподин|[Гг]оспожа|Автор:|Контакт:) (?P<ru2>[А-ЯЁ][а-яё]+(?: [А-ЯЁ][а-яё]+){0,2}))"
)
_NATIVE_MARK = re.compile(rf"[А-ЯЁ]|[{_HAN}]")


class _Taken:
    """Spans of one text that don't overlap, in order."""

    def __init__(self) -> None:
        self.starts: list[int] = []
        self.ends: list[int] = []

    def free(self, a: int, b: int) -> bool:
        i = bisect(self.starts, a)
        return not (i and self.ends[i - 1] > a) and not (i < len(self.starts) and self.starts[i] < b)

    def put(self, a: int, b: int) -> None:
        i = bisect(self.starts, a)
        self.starts.insert(i, a)
        self.ends.insert(i, b)


def _case(text: str) -> int:
    words = re.findall(rf"[{_L}]{{3,}}", text)
    return 1 if all(w[0].isupper() and w[1:].islower() for w in words) else 0


_LETTERS = frozenset(c for c in map(chr, range(0x250)) if re.match(f"[{_L}]", c))


def _occurrences(text: str, words: list[str]) -> list[tuple[int, int, str]]:
    """(start, end, word) of each place where one of the words stands between other characters than letters, in order."""
    out = []
    for w in words:
        a = text.find(w)
        while a >= 0:
            b = a + len(w)
            if not (a and text[a - 1] in _LETTERS) and text[b : b + 1] not in _LETTERS:
                out.append((a, b, w))
            a = text.find(w, b)
    out.sort()
    return out


def _person_spans(text: str, words: set[str], names: Gazetteer) -> Iterator[tuple[int, int, str, list[tuple[str, int]]]]:
    """(start, end, form, [(word, wanted bits)]) of what may be a name by its words."""
    kind, until = names.kind, 0
    hits = [w for w in words - names.no if kind(w)]
    for a, b, word in _occurrences(text, hits) if hits else ():
        if a < until:
            continue
        bits = kind(word)
        if bits & GIVEN and (f := _FULL.match(text, b)):
            parts = [f.group(2)] + ([f.group(3)] if f.group(3) else [])
            plain = [p.split("'")[-1].split("’")[-1] for p in parts]
            if kind(plain[0]) & FAMILY or (f.group(1) and plain[0][0].isupper() and kind(plain[0])):
                end = f.end()
                if f.group(3) and not kind(plain[1]) & FAMILY:
                    end = f.start(3) - 1
                    plain = plain[:1]
                yield a, end, "full", [(word, GIVEN), *((p, FAMILY) for p in plain)]
                until = end
                continue
        if bits & FAMILY:
            before = text[max(0, a - 14) : a]
            if i := _INITIAL.search(before):
                d = _DOUBLE.match(text, b)
                end = d.end() if d and kind(d.group(1)) & FAMILY else b
                yield a - (len(before) - i.start()), end, "initial", [(word, FAMILY)]
                until = end
                continue
            r = _REVERSED.match(text, b)
            if r and kind(r.group(2)) & GIVEN and not (r.group(1) and not kind(r.group(1)) & FAMILY):
                nxt = _FULL.match(text, r.end(2))
                if not (nxt and kind(nxt.group(2)) & FAMILY):  # else the given name belongs to the next one
                    yield a, r.end(), "reversed", [(word, FAMILY), (r.group(2), GIVEN)]
                    until = r.end()
                    continue
        d = _DOUBLE.match(text, b)
        end = d.end() if d and kind(d.group(1)) else b
        yield a, end, "given" if bits & GIVEN and not (bits & 2 and not bits & 1) else "family", [(word, GIVEN if bits & GIVEN else FAMILY)]
        until = end


def _line_start(before: str) -> bool:
    """Whether nothing but blanks stands before on the line."""
    lead = before.rstrip(" \t")
    return not lead or lead[-1] in "\r\n"


def _email_votes(text: str, a: int, b: int, s: str) -> tuple[int, ...]:
    before, after = text[max(0, a - 24) : a], text[b : b + 3]
    plain = "@" in s or "＠" in s
    form = 1 if plain and " " not in s else 0 if plain or re.search(r"[\[({<]", s) else -1
    cue = 1 if _MAIL_CUE.search(before) or not before or before[-1] in "\n(" else 0
    last = re.split(r"[^a-z]+", s.lower().rstrip(")]"))[-1]
    local = re.split(r"[@＠\s\[({<]", s.lower(), maxsplit=1)[0]
    sample = -1 if "{" in after or local in _NOBODY or _SAMPLE_BEFORE.search(before) else 0
    joined = -1 if before.endswith(("://", "/", "@", "=")) or after[:1] in ("/", "@") or re.match(r":\w", after) else 1
    return form, cue, 1 if 2 <= len(last) <= 10 else -1, sample, joined


def _id_votes(text: str, m: re.Match) -> tuple[int, ...]:
    a, b = m.span("value")
    value, before, after = m.group("value"), text[max(0, m.start() - 24) : m.start()], text[b : b + 12]
    digits = re.sub(r"\D", "", value)
    plain = len(set(digits)) == 1 or digits in "01234567890123456789" or digits in "98765432109876543210"
    near = re.search(r"(?i)(?:file|line|attached|leaked|form)\W{1,3}$|\b(?:leaked|my|your|his|her) $", before)
    return 1 if m.group("sep") else 0, 1 if _ID_STRICT.match(value) else -1, -1 if _SAMPLE_BEFORE.search(before) or _NO_PAPER.search(before) else 1 if near else 0, -1 if plain or _UNIT_AFTER.match(after) else 1


def _address_votes(text: str, a: int, b: int, form: str, s: str) -> tuple[int, ...]:
    before, after = text[max(0, a - 24) : a], text[b : b + 12]
    code = bool(re.search(rf"{_UK_CODE}|{_US_CODE}|\d{{5}} ", s))
    house = re.search(r"\d+", s).group()
    year = len(house) == 4 and "1900" <= house <= "2099" and not code
    against = bool(_NO_PLACE.search(before)) or bool(_UNIT_AFTER.match(after)) or bool(_SAMPLE_BEFORE.search(before))
    line = not before or before[-1] in "\n|/：" or before.endswith((" | ", " / "))
    return -1 if year else 1, 1 if code else 0, 1 if _PLACE_CUE.search(before) else 0, 1 if line else 0, -1 if against else 1


def _phone_votes(text: str, a: int, b: int, form: str, s: str) -> tuple[int, ...]:
    before, after = text[max(0, a - 28) : a], text[b : b + 12]
    against = bool(_NOT_PHONE.search(before)) or bool(_SAMPLE_BEFORE.search(before))
    alone = _line_start(before) or before.endswith(("tel:", ". ", "! ", "? ")) or after.startswith((" | ", " / "))
    odd = bool(_UNIT_AFTER.match(after)) or before.endswith(("$", "€", "£", "$ ", "€ ", "£ "))
    return 1 if form in ("abroad", "bracket") else 0, 1 if _PHONE_CUE.search(before) else 0, -1 if against else 1 if not re.search(r"[\w#°]\.?:? ?$", before) else 0, 1 if alone else 0, -1 if odd else 0


def _person_votes(text: str, a: int, b: int, form: str, parts: list[tuple[str, int]], names: Gazetteer) -> tuple[int, ...]:
    before, after = text[max(0, a - 32) : a], text[b : b + 24]
    bits = [(names.kind(w), want) for w, want in parts]
    listed = sum(bool(x & want & 3) for x, want in bits)
    made = form == "native" or all(x & want & 12 for x, want in bits)
    alone = form in ("given", "family")
    cue = form in ("cued", "native") or bool(_TITLE.search(before) or _GREETING.search(before)) or (not alone and bool(_ROLE.search(before) or _CLOSING.search(before)))
    no = bool(_NO_PERSON_AFTER.match(after)) or (bool(_NO_PERSON_BEFORE.search(before)) and alone)
    said = bool(_SAID_AFTER.match(after)) or (after.startswith(", ") and after[2:3].isupper())
    return (
        1 if listed == len(parts) else 0 if listed else -1, 1 if made else -1, 1 if cue else -1 if alone else 0, (1 if said else 0) if not alone else (1 if re.match(r"[!,] ?\s|[!,:–]| –", after) and cue else -1),
        -1 if no else 1, _case(text[a:b]) if not alone else (1 if cue and _case(text[a:b]) else -1),
    )


#: What a text must hold for a grammar to match; cheaper than the grammar.
_ID_WORDS = frozenset("ssn itin tin nino social dni nie nif nir tax taxpayer fiscal numéro carte card".split())
_ID_STEMS = ("ni n", "national ins", "passport", "reisepass", "ausweis", "licen", "führerschein", "steuer", "sozialversicherung", "sécurité", "passeport", "seguridad", "pasaporte", "insurance", "身份证", "护照", "パスポート", "旅券", "マイナンバー", "社保")
_FIVE = re.compile(r"\d{5}")
_STREET_WORDS = frozenset("Street Lane Road Avenue Ave Court Row Close Terrace Terr Way Drive Place Square Boulevard Blvd Crescent Gardens Hill Mews Walk Parade Quay Yard Alley Grove Rise View Wharf Highway Parkway Pkwy".split())
_STREET_SHORT = re.compile(r" (?:St|Ln|Rd|Ct|Dr|Pl|Sq)\b")


def candidates(text: str, names: Gazetteer) -> list[tuple[str, int, int, str, tuple[int, ...]]]:
    """(kind, start, end, form, votes) of every proposed span of a text; none overlap."""
    out, taken = [], _Taken()

    def put(kind: str, a: int, b: int, form: str, votes: tuple[int, ...]) -> None:
        out.append((kind, a, b, form, votes))
        taken.put(a, b)

    words = set(WORD.findall(text))
    if any(c in text for c in "@＠") or _AT_MARK.search(text):
        for m in EMAIL.finditer(text):
            s = m.group()
            put("email", *m.span(), "at" if "@" in s or "＠" in s else "spelled", _email_votes(text, *m.span(), s))
    if any(map(str.isdigit, text)):
        low = text.lower()
        if not _ID_WORDS.isdisjoint(map(str.lower, words)) or any(w in low for w in _ID_STEMS):
            for m in ID.finditer(text):
                a, b = m.span("value")
                if taken.free(a, b) and any(c.isdigit() for c in m.group("value")):
                    put("id_number", a, b, "strict" if _ID_STRICT.match(m.group("value")) else "loose", _id_votes(text, m))
        if not _STREET_WORDS.isdisjoint(words) or _STREET_SHORT.search(text) or _FIVE.search(text):
            for m in ADDRESS.finditer(text):
                if taken.free(*m.span()):
                    put("address", *m.span(), m.lastgroup, _address_votes(text, *m.span(), m.lastgroup, m.group()))
        for m in PHONE.finditer(text):
            if taken.free(*m.span()) and 7 <= sum(c.isdigit() for c in m.group()) <= 15:
                form = m.lastgroup if m.lastgroup in _PHONES else next(k for k in _PHONES if m.group(k))
                put("phone", *m.span(), form, _phone_votes(text, *m.span(), form, m.group()))
    for a, b, form, parts in _person_spans(text, words, names):
        if taken.free(a, b):
            put("person", a, b, form, _person_votes(text, a, b, form, parts, names))
    # Names of which no word is known, where the surroundings say that one stands there.
    cued = not words.isdisjoint(_CUE_WORDS) or any(c in text for c in _SHORT_CUES)
    for m in _CUED.finditer(text) if cued else ():
        a, b = m.span("name")
        parts = [(w, FAMILY) for w in re.findall(rf"[{_UP}][{_LOW}'’]+", m.group("name"))]
        if not text[max(0, m.start() - 1) : m.start()].isalnum() and taken.free(a, b) and not any(names.kind(w) for w, _ in parts):
            put("person", a, b, "cued", _person_votes(text, a, b, "cued", parts, names))
    if _NATIVE_MARK.search(text):
        for m in _NATIVE.finditer(text):
            a, b = m.span(m.lastgroup)
            if taken.free(a, b):
                put("person", a, b, "native", _person_votes(text, a, b, "native", [(text[a:b], FAMILY)], names))
    return out


#: Words as the grammars see them: with case ignored, the class has a few more letters.
_RUNS = re.compile(rf"[{_L}]{{2,}}"), re.compile(rf"[{_L}]{{2,}}", re.I)
_APOSTROPHE = re.compile(rf"[{_UP}][{_LOW}]*['’][{_LOW}'’]*")


def asked(text: str) -> set[str]:
    """Every word, case-folded, that :func:`candidates` may ask the gazetteer about."""
    words = {w for runs in _RUNS for w in runs.findall(text)}
    for w in _APOSTROPHE.findall(text):  # a cued name may end before its last apostrophe
        words |= {w, w[: max(w.rfind("'"), w.rfind("’"))]}
    if _NATIVE_MARK.search(text):
        words |= {m.group(m.lastgroup) for m in _NATIVE.finditer(text)}
    return {w.casefold() for w in words}


#: Features of a span, and the weights they share by hash.
N_FEATURES, WEIGHTS = 14, 4096
_SHAPES = ((re.compile(r"\d+"), "9"), (re.compile(rf"[{_UP}]+"), "A"), (re.compile(rf"[{_LOW}]+"), "a"))
_ALNUM = re.compile(r"[^\W_]+")


def features(text: str, a: int, b: int, kind: str) -> list[int]:
    """Hashed features of a span and its surroundings: what it looks like and what stands next to it."""
    s, before, after = text[a:b], text[max(0, a - 24) : a], text[b : b + 24]
    shape = s[:80]
    for pattern, sign in _SHAPES:
        shape = pattern.sub(sign, shape)
    words, nxt = _ALNUM.findall(before), _ALNUM.search(after)
    prev, nxt = (words[-1].lower() if words else ""), (nxt.group().lower() if nxt else "")
    side = lambda c: "a" if c.isalpha() else "9" if c.isdigit() else c
    own = (
        shape, str(min(len(s), 60) // 4), str(s.count(" ")), s[:3].lower(), s[-3:].lower(), prev, nxt, side(before[-1:]), side(after[:1]), side(before[-1:]) + side(after[:1]),
        before[-2:-1] + before[-1:], after[:2], "start" if not before or before[-1] == "\n" else "", "end" if not after or after[0] in "\r\n" else "",
    )
    return [xxhash.xxh32_intdigest(f"{kind}{i}\0{x}".encode("utf-8", "surrogatepass")) % WEIGHTS for i, x in enumerate(own)]


def _code(kind: str, form: str, votes: tuple[int, ...]) -> int:
    code = FORMS[kind].index(form)
    for v in votes:
        code = code * 3 + v + 1
    return code


def _decode(kind: str, code: int) -> tuple[str, tuple[int, ...]]:
    votes = []
    for _ in LABELERS[kind]:
        code, v = divmod(code, 3)
        votes.append(v - 1)
    return FORMS[kind][code], tuple(reversed(votes))


def estimate(votes: np.ndarray, counts: np.ndarray, rounds: int = 100) -> np.ndarray:
    """Probability that the spans of each vote pattern are true, by expectation maximisation.

    Labelers err independently given the truth. A prior as strong as a tenth of the data (twenty spans at least)
    holds that a true span has 6 : 3 : 1 votes for it, none, against it, and a false one the reverse. It says which
    of the two classes is the true one.
    """
    p = 1 / (1 + np.exp(-1.5 * votes.sum(1)))
    strength = max(20.0, 0.1 * counts.sum())
    for _ in range(rounds):
        prior = np.clip((counts * p).sum() / counts.sum(), 0.02, 0.98)
        logit = np.full(len(p), np.log(prior / (1 - prior)))
        for j in range(votes.shape[1]):
            seen = [votes[:, j] == v for v in (-1, 0, 1)]
            true = np.array([(counts * p)[s].sum() for s in seen]) + strength * np.array([0.1, 0.3, 0.6])
            false = np.array([(counts * (1 - p))[s].sum() for s in seen]) + strength * np.array([0.6, 0.3, 0.1])
            ratio = np.log(true / true.sum()) - np.log(false / false.sum())
            # A vote for a span never speaks against it, nor the other way round.
            ratio[2], ratio[0] = max(ratio[2], 0.0), min(ratio[0], 0.0)
            for s, r in zip(seen, ratio):
                logit[s] += r
        new = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        if np.abs(new - p).max() < 1e-6:
            break
        p = new
    return p


#: Rounds of training.
ROUNDS = 150


def gradient(w: np.ndarray, base: float, indexes: np.ndarray, target: np.ndarray, step: int = 16_384) -> np.ndarray:
    """By weight, the errors of the spans that have it: what some spans add to the gradient."""
    out = np.zeros(WEIGHTS)
    for i in range(0, len(indexes), step):
        x = indexes[i : i + step].astype(np.intp)
        p = 1 / (1 + np.exp(-np.clip(base + w[x].sum(1), -30, 30)))
        out += np.bincount(x.ravel(), np.repeat(p - target[i : i + step], x.shape[1]), WEIGHTS)
    return out


def train(totals: dict[str, int], errors: Callable[[dict[str, np.ndarray]], dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
    """Weights by kind of a logistic regression over hashed features on probabilities; a span's evidence is against the share of true ones.

    ``errors`` has the gradients over all spans of each kind, whose numbers are ``totals``.
    """
    weights, scales = ({k: np.full(WEIGHTS, x) for k in totals} for x in (0.0, 1e-6))
    for _ in range(ROUNDS):
        for k, own in errors(weights).items():
            grad = own / totals[k] + 2.0 / totals[k] * weights[k]
            scales[k] += grad**2
            weights[k] -= 0.3 * grad / np.sqrt(scales[k])
    return weights


class Decision:
    """What decides spans: the estimate of each pattern as log odds, and the classifier's weights, by kind."""

    #: How far either may speak at most, in log odds.
    ESTIMATE, CONTEXT = 6.0, 2.0

    def __init__(self, odds: dict[str, dict[int, float]], weights: dict[str, np.ndarray]) -> None:
        self.odds, self.weights = odds, weights

    def accepts(self, kind: str, pattern: int, own: list[int]) -> bool:
        odds = self.odds.get(kind, {}).get(pattern)
        if odds is None:
            return False
        weights = self.weights.get(kind)
        context = 0.0 if weights is None else float(np.clip(weights[own].sum(), -self.CONTEXT, self.CONTEXT))
        return odds + context > 0


def pattern_odds(counts: dict[str, dict[int, int]]) -> dict[str, dict[int, float]]:
    """Log odds of each pattern of each kind."""
    out = {}
    for kind, own in sorted(counts.items()):
        codes = sorted(own)
        votes = np.array([_decode(kind, c)[1] for c in codes], dtype=float)
        p = np.clip(estimate(votes, np.array([own[c] for c in codes], dtype=float)), 1e-9, 1 - 1e-9)
        out[kind] = dict(zip(codes, np.clip(np.log(p / (1 - p)), -Decision.ESTIMATE, Decision.ESTIMATE).tolist()))
    return out


_SPAN = "kind string, start_char int, end_char int, pattern int, features array<int>"


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([n.casefold() for n in batch.column(0).to_pylist()], pa.string()), batch.column(1)], ["_w", "name_part"])


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words = [sorted(asked(t)) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.list_(pa.string()))], ["_id", "_words"])


class _Finder:
    """Proposes spans of texts: the gazetteer in the task's memory, or the known words of each text from a join."""

    def __init__(self, df: DataFrame, id_col: str, text_col: str, names: DataFrame) -> None:
        spark = df.sparkSession
        named = names.select("name", "name_part").where("name is not null")
        few = [(r[0], r[1]) for r in named.limit(MOST_NAMES + 1).collect()]
        self.joined = len(few) > MOST_NAMES
        self.shared = spark.sparkContext.broadcast([] if self.joined else few)
        self.texts = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
        if self.joined:
            self.texts = self._with_listed(named)

    def _with_listed(self, named: DataFrame) -> DataFrame:
        """Texts with what the whole gazetteer says of their words, as :meth:`Gazetteer.kind` does, whatever its size."""
        folded = named.where("name != ''").mapInArrow(_folded, "_w string, name_part string")
        listed = cut(folded.groupBy("_w").agg(F.bit_or(F.when(F.col("name_part") == "given", 1).otherwise(2)).alias("_bits")), "listed")
        id_type = self.texts.schema["_id"].dataType
        words = cut(self.texts.where("_text is not null").mapInArrow(_asked, T.StructType([T.StructField("_id", id_type), T.StructField("_words", T.ArrayType(T.StringType()))])), "words")
        each = words.select("_id", F.explode("_words").alias("_w"))
        at = F.explode(F.sequence(F.lit(3), F.length("_w") - 2)).alias("_at")
        pieces = {"_begin": F.expr("substring(_w, 1, _at)"), "_end": F.expr("substring(_w, _at + 1)")}
        made = each.where(F.length("_w") > 4).select("_w").distinct().select("_w", at).withColumns(pieces)
        for name, piece in pieces.items():
            bits = sum(F.when(F.count_if(F.col("_bits").bitwiseAND(part) > 0) >= Gazetteer.LEAST, 4 * part).otherwise(0) for part in (1, 2))
            affixes = listed.where(F.length("_w") > 4).select("_w", "_bits", at).groupBy(piece.alias(name)).agg(bits.alias(f"{name}_bits"))
            made = made.join(affixes.where(f"{name}_bits > 0"), name)
        known = listed.union(made.select("_w", F.col("_begin_bits").bitwiseAND(F.col("_end_bits")))).groupBy("_w").agg(F.bit_or("_bits").alias("_bits")).where("_bits > 0")
        # A frequent word is on the left side only, where a skewed partition is split.
        own = each.join(known, "_w").groupBy(F.col("_id").alias("_key")).agg(F.map_from_entries(F.collect_set(F.struct("_w", "_bits"))).alias("_listed"))
        return self.texts.join(own, F.col("_id").eqNullSafe(F.col("_key")), "left").drop("_key")

    def map(self, each, schema: T.StructType) -> DataFrame:
        """Rows of ``each(text, gazetteer)`` for each text: (id, values) as the schema has them."""
        shared, joined = self.shared, self.joined

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            gazetteer = Gazetteer(shared.value)
            arrow = [pa.int32() if isinstance(f.dataType, T.IntegerType) else pa.list_(pa.int32()) if isinstance(f.dataType, T.ArrayType) else pa.string() for f in schema.fields[1:]]
            for batch in batches:
                at, rows = [], []
                listed = batch.column(2).to_pylist() if joined else None
                for i, text in enumerate(batch.column(1).to_pylist()):
                    if joined:
                        gazetteer.tell(dict(listed[i] or ()))
                    for row in each(text, gazetteer):
                        at.append(i)
                        rows.append(row)
                cols = list(zip(*rows)) or [[]] * len(arrow)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *(pa.array(list(c), t) for c, t in zip(cols, arrow))], schema.names)

        return self.texts.select("_id", "_text", *(["_listed"] if joined else [])).mapInArrow(run, schema)


def _proposals(text: str | None, gazetteer: Gazetteer) -> Iterator[tuple]:
    if text:
        for kind, a, b, form, votes in candidates(text, gazetteer):
            yield kind, a, b, _code(kind, form, votes), features(text, a, b, kind)


#: Spans of a block of training data, which makes rows of 4 KB, and tasks that sum gradients at most (160 KB from each).
BLOCK, SUMMING = 128, 200


def _blocks(spans: DataFrame) -> DataFrame:
    """All spans as training data: blocks of one kind, patterns and features as two bytes each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds, patterns = np.array(batch.column(0).to_pylist(), dtype=object), batch.column(1).to_numpy().astype("<u2")
            own = batch.column(2).flatten().to_numpy().reshape(-1, N_FEATURES).astype("<u2")
            rows = []
            for kind in KINDS:
                at = np.flatnonzero(kinds == kind)
                rows += [(kind, patterns[x].tobytes(), own[x].tobytes()) for x in np.split(at, range(BLOCK, len(at), BLOCK)) if len(x)]
            yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows], pa.schema(list(zip(names, (pa.string(), pa.binary(), pa.binary())))))

    names = ("kind", "patterns", "features")
    return spans.select("kind", "pattern", "features").mapInArrow(run, "kind string, patterns binary, features binary")


def _unpacked(blocks: Iterable[tuple], chances: dict[str, np.ndarray]) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Features and targets by kind; ``chances`` has the target of each pattern."""
    parts: dict[str, tuple[list, list]] = {}
    for kind, patterns, own in blocks:
        mine = parts.setdefault(kind, ([], []))
        mine[0].append(patterns)
        mine[1].append(own)
    return {k: (np.frombuffer(b"".join(x), "<u2").reshape(-1, N_FEATURES), chances[k][np.frombuffer(b"".join(p), "<u2")]) for k, (p, x) in parts.items()}


def _summed(blocks: DataFrame, weights: dict[str, np.ndarray], bases: dict[str, float], chances: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """The gradients by kind, summed by the executors; a number for each weight comes back from a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for k, (own, target) in _unpacked(zip(*(c.to_pylist() for c in batch.columns)), chances).items():
                sums[k] = sums.get(k, 0.0) + gradient(weights[k], bases[k], own, target)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["kind", "sums"])

    out = {k: np.zeros(WEIGHTS) for k in weights}
    for k, sums in blocks.coalesce(SUMMING).mapInArrow(run, "kind string, sums binary").collect():  # weights, not spans
        out[k] += np.frombuffer(sums)
    return out


def _decision(spans: DataFrame) -> Decision:
    """Counts the patterns of all spans, estimates, and trains on all spans."""
    counts: dict[str, dict[int, int]] = {}
    for r in spans.groupBy("kind", "pattern").agg(F.count("*").alias("n")).collect():  # patterns, not spans
        counts.setdefault(r["kind"], {})[r["pattern"]] = r["n"]
    odds = pattern_odds(counts)
    totals, chances, bases = {}, {}, {}
    for k, own in odds.items():
        codes, n = list(own), np.array([counts[k][c] for c in own], dtype=float)
        chances[k] = np.zeros(max(codes) + 1)
        chances[k][codes] = 1 / (1 + np.exp(-np.array(list(own.values()))))
        totals[k] = int(n.sum())
        true = np.clip(n @ chances[k][codes] / n.sum(), 0.02, 0.98)
        bases[k] = float(np.log(true / (1 - true)))
    blocks = _blocks(spans)
    if sum(totals.values()) <= HELD_SPANS:
        held = _unpacked(blocks.collect(), chances)
        weights = train(totals, lambda w: {k: gradient(w[k], bases[k], *own) for k, own in held.items()})
    else:
        blocks = cut(blocks, "training")
        weights = train(totals, lambda w: _summed(blocks, w, bases, chances))
    return Decision(odds, weights)


def _found(df: DataFrame, id_col: str, text_col: str, names: DataFrame) -> tuple[_Finder, DataFrame, Decision]:
    finder = _Finder(df, id_col, text_col, names)
    schema = T.StructType([T.StructField("_id", df.schema[id_col].dataType), *T._parse_datatype_string(_SPAN)])
    spans = cut(finder.map(_proposals, schema), "spans")
    return finder, spans, _decision(spans)


def find(df: DataFrame, id_col: str, text_col: str, names: DataFrame) -> DataFrame:
    """(id, kind, start_char, end_char) of every piece of personal information.

    ``names`` has name and name_part (given or family).
    """
    _, spans, decision = _found(df, id_col, text_col, names)
    shared = df.sparkSession.sparkContext.broadcast(decision)

    def accepted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decide = shared.value.accepts
        for batch in batches:
            kinds, patterns, own = (batch.column(i).to_pylist() for i in (1, 4, 5))
            keep = pa.array([decide(k, p, f) for k, p, f in zip(kinds, patterns, own)], pa.bool_())
            yield batch.select([0, 1, 2, 3]).filter(keep)

    schema = T.StructType([T.StructField("_id", df.schema[id_col].dataType), *T._parse_datatype_string("kind string, start_char int, end_char int")])
    return spans.mapInArrow(accepted, schema).withColumnRenamed("_id", id_col)


def redact(df: DataFrame, id_col: str, text_col: str, names: DataFrame) -> DataFrame:
    """(id, text) with each piece replaced by its kind in brackets; texts without pieces stay as they are.

    Spans are decided again in the task that holds the text, so texts aren't shuffled.
    """
    finder, _, decision = _found(df, id_col, text_col, names)
    shared = df.sparkSession.sparkContext.broadcast(decision)

    def replaced(text: str | None, gazetteer: Gazetteer) -> Iterator[tuple]:
        parts, at = [], 0
        for kind, a, b, pattern, own in sorted(_proposals(text, gazetteer), key=lambda x: x[1]):
            if shared.value.accepts(kind, pattern, own):
                parts += [text[at:a], f"[{kind.upper()}]"]
                at = b
        yield ("".join((*parts, text[at:])) if parts else text,)

    schema = T.StructType([T.StructField("_id", df.schema[id_col].dataType), T.StructField("_text", T.StringType())])
    return finder.map(replaced, schema).withColumnsRenamed({"_id": id_col, "_text": text_col})
