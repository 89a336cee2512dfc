"""Abbreviations that carry a full stop, by what may follow them. Lower case, inner stops kept, the last one left off.

The lists go by language. That of a text is told from its script and its frequent words, since a document's language tag is often missing or wrong.
"""

# Titles and other words that only stand before a name or the rest of a phrase; a stop after them never ends a sentence.
NEVER_ENDS = {
    "en": frozenset("mr mrs ms mx dr drs prof hon rev st messrs gen col maj capt lt sgt cmdr adm gov sen rep pres supt insp sr i.e e.g i.a viz cf vs v approx".split()),
    "de": frozenset(
        """
        hr hrn frl fr abg fa dipl ing mag dr prof hl geb sog bzw ggf evtl inkl exkl zzgl vgl ca z.b z d.h d u.a u u.ä i.a v vs abb anl kap bd bde nr nrn abs
        ziff lit rdnr randnr art st rep messrs
        """.split()
    ),
    "fr": frozenset("m mm mme mlle mgr me pdt pdte cie dr drs prof st ste hon art arts env cf c.-à-d càd p.ex ex av bd vs v ch chap vol vols pp n nº tab fig figs".split()),
    "es": frozenset(
        "sr sra srta sres sras d dr dra dña prof excmo excma ilmo ilma rdo ud uds vd vds ee aprox p.ej ej pág págs pp cap caps art arts núm núms nº n apdo párr fig figs tab av avda vs v vol vols st".split()
    ),
    "ru": frozenset("г-н г-жа д-р проф акад доц тов им ул пр-т пл пос дер обл р-н см ср ст ч гл рис табл прил п пп стр с т.е т.н напр тыс".split()),
    "el": frozenset("δρ κ κκ κα καθ αρ άρθρ άρθ βλ σελ σσ π.χ δηλ παρ κεφ τηλ λεωφ αγ".split()),
}
# Frequent words of the languages that share the Latin script, by which a text's language is told.
FUNCTION_WORDS = {
    "en": frozenset("the of and to is that for with was not has have by this be it are from at which an as will said he she they we you his her but then who its".split()),
    "de": frozenset("der die das und nicht ist wir den von zu dem ein eine mit hat auf für im des sich bei er sie es".split()),
    "fr": frozenset("le la les des et est nous pas une dans du que qui au pour ne sur par ce il un été à où".split()),
    "es": frozenset("el la los las de que y en una por del se ha no para con su al es lo un más".split()),
}
# Words that mostly stand before a number, but may end a sentence before a new one that begins with a capital.
BEFORE_NUMBER = frozenset(
    "no nos nr sec secs art arts fig figs p pp vol vols ch chap chaps para paras pt pts tab ed eds n nº núm núms pág págs s abs".split()
)
# Words that may end a sentence if a new one follows.
MAY_END = frozenset(
    """
    etc usw u.s.w usf al co ltd inc corp bros jr sen jun plc u.s u.k u.n e.u a.m p.m ff f uu v.h d.c b.c a.d jan feb mar apr jun jul aug sept sep oct okt nov
    dec dez ene abr ago dic janv févr avr juil déc mio mrd mill dept est approx.s
    т.д д т.п п др пр г гг в вв руб коп млн млрд
    κ.λπ κλπ κ.ά κ.α μ.μ π.μ χιλ εκ δισ
    """.split()
)
# Abbreviations of scripts without letter case, where a stop is seldom anything else.
CASELESS = frozenset("डॉ प्रो पृ श्री सं क्र रु कु पं मो ई ดร นพ พญ ผศ รศ ศ พ.ศ ค.ศ น พ ม ต อ จ ร.ต พล.อ ص د أ م ه ق ت ج".split())
# German words before which or after which a number with a stop is an ordinal.
ORDINAL_BEFORE = frozenset(
    "am im zum zur vom beim der die das dem den des ein eine einem einen einer ihr ihre sein seine unser unsere dieser diesem diesen jeder ab bis seit und oder".split()
)
ORDINAL_AFTER = frozenset("januar februar märz april mai juni juli august september oktober november dezember jahrhundert quartal wahlperiode sitzung".split())
# Verbs of reporting clauses that follow a quotation.
REPORTING = frozenset(
    """
    said says asked asks replied replies answered insisted added cried shouted declared warned noted remarked continued wrote told observed
    sagte sagt fragte rief antwortete erklärte meinte erwiderte dit dis demanda répondit déclara cria ajouta dijo preguntó respondió añadió exclamó declaró
    сказал сказала спросил спросила ответил ответила заявил заявила είπε ρώτησε απάντησε δήλωσε
    """.split()
)
# Abbreviations that go on from the one before them, as in a company's name.
SUFFIXES = frozenset("ltd inc corp co plc jr sr llc gmbh ag uu".split())
