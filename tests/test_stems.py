from townledger.functions.stems import stems

# Words of the published sample vocabulary of the rules, with their stems.
SAMPLE = """consign consign consigned consign consigning consign consignment consign consist consist consisted consist consistency consist consistent consist consistently consist consisting consist consists consist
consolation consol consolations consol consolatory consolatori console consol consoled consol consoles consol consolidate consolid consolidated consolid consolidating consolid consoling consol consolingly consol
consols consol consonant conson consort consort consorted consort conspicuous conspicu conspicuously conspicu conspiracy conspiraci conspirator conspir conspirators conspir conspire conspir conspired conspir
constable constabl constables constabl constance constanc constancy constanc constant constant
knack knack knackeries knackeri knacks knack knag knag knave knave knaves knave knavish knavish kneaded knead kneading knead knee knee kneel kneel kneeled kneel kneeling kneel kneels kneel knees knee knell knell
knelt knelt knew knew knick knick knif knif knife knife knight knight knightly knight knights knight knit knit knits knit knitted knit knitting knit knives knive knob knob knobs knob knock knock knocked knock
knocker knocker knockers knocker knocking knock knocks knock knopp knopp knot knot knots knot""".split()
RULES = """caresses caress flies fli dies die ties tie gas gas this this gaps gap kiwis kiwi feed feed agreed agre plastered plaster bled bled motoring motor sing sing hopping hop hoping hope falling fall happy happi by by say say
relational relat conditional condit valency valenc digitizer digit operator oper feudalism feudal decisiveness decis hopefulness hope formality formal sensitivity sensit sensibility sensibl analogy analog boldly bold
triplicate triplic formative format electricity electr hopeful hope goodness good revival reviv allowance allow inference infer airliner airlin adjustable adjust replacement replac adoption adopt communism communism
generate generat generously generous news news skies sky dying die inning inning proceeds proceed youth youth yes yes enjoy enjoy controll control roll roll rate rate cease ceas a a is is 2024 2024 b2b b2b""".split()


def test_stems_of_a_word_list(spark):
    pairs = [(SAMPLE + RULES)[i : i + 2] for i in range(0, len(SAMPLE + RULES), 2)]
    got = {r["word"]: r["stem"] for r in stems(spark.createDataFrame([(w,) for w, _ in pairs] + [(None,), ("",)], "word string")).collect()}
    assert {w: got[w] for w, s in pairs} == dict(pairs)
    assert got[None] is None and got[""] == ""
