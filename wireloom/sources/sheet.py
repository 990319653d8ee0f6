"""The example sheet: netlist tables of one power supply drawing, as DataFrames.

Descriptions are short and our own; ids, classes, nets, colours, gauges and cables are facts of the drawing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

DRAWING_NO = "PS20115MLM4-2"

# The drawing's facts.
REFERENCES = ["MXCS-M9", "MXCS-M11", "MXCS-P9", "MXCS-P11"]
DRAWING = (DRAWING_NO, None, "Power supply assembly, master, 4 drive cards", "2017-09-19", "Mod-Linx Power Supply Assembly", REFERENCES, ["Keep DC wires 4 inch clear of 115VAC wires.", "Do not double place wires.", "Label wires and cables 1 inch from the end."])

# Id | class | power domain | zone | ratings | part number | aliases
COMPONENTS = """
PLG1|cable_plug|115VAC|top-left|voltage=115VAC;phase=1;frequency=60Hz;pins=3|LEV2611|power in plug;input plug
PLG2|cable_plug|115VAC|top-left|voltage=115VAC;phase=1;frequency=60Hz;pins=3|LEV2613|power out plug;output plug
TB-L1|terminal_block|115VAC|top-left|||terminal L1
TB-N|terminal_block|115VAC|top-left|||neutral terminal
TB-GND-A|terminal_block|0V_common|top-left|||plug ground terminal
DISC1|switch|115VAC|top-centre-left|poles=3;poles_used=2||panel disconnect;main disconnect
CB1|circuit_breaker|115VAC|top-centre|current=8A;poles=1;voltage=115VAC||8 amp breaker;main breaker
PS1|power_supply|24VDC|top-centre|input=115VAC 1 phase 60Hz;output=24VDC;current=20A||20AMP POWER SUPPLY;power supply
TB-GND-B|terminal_block|0V_common|top-centre|||door ground terminal
DOOR-GND|ground|0V_common|top-centre|||door earth
EARTH|ground|0V_common|top|||protective earth
CB2|circuit_breaker|24VDC|top-centre-right|current=20A;poles=1;voltage=24VDC||20 amp breaker;DC breaker
TB-24E1-A|terminal_block|24VDC|left edge|points=8||main 24V terminal block
TB-24E1-B|terminal_block|24VDC|centre|points=6||secondary 24V terminal block
TB-0V|terminal_block|0V_common|right|||common terminal strip
SPD1|speed_controller|24VDC|top-right|supply=24VDC;terminals=3||speed controller
TB-SPD|terminal_block|control_signal|top-right|||speed terminal
REVERSE-CB|circuit_breaker|24VDC|centre|current=5A;poles=1||reverse breaker;reverse switch
TB-DIR|terminal_block|control_signal|centre|||direction terminal
PB1|push_button|control_signal|left|terminals=4;supply=24VDC||start/stop switch 1
PB2|push_button|control_signal|left|terminals=4;supply=24VDC||start/stop switch 2
TB-PB1SP|terminal_block|control_signal|left|||PB1 spare terminal
TB-PB2SP|terminal_block|control_signal|left|||PB2 spare terminal
LT1|indicator_light|24VDC|left-centre|conductors=4;conductors_used=2||circuit 1 light
CR1|relay|24VDC|right-centre|coil_voltage=24VDC;contacts=1 N.O.||start stop relay 1
CR2|relay|24VDC|right-centre|coil_voltage=24VDC;contacts=1 N.O.||start stop relay 2
CR-ON|relay|24VDC|right-centre|coil_voltage=24VDC;contacts=1 N.O.||run relay
CR-BP|relay|24VDC|bottom-right|coil_voltage=24VDC;contacts=1 N.C. + 1 N.O.||run bypass relay
CR-SW|relay|24VDC|bottom-right|coil_voltage=24VDC;contacts=1 N.O.||switch relay
BYPASS-CB|circuit_breaker|24VDC|bottom-centre|current=5A;poles=1||bypass breaker;bypass switch
TB-RUN|terminal_block|control_signal|centre|||run terminal
TB-110|terminal_block|control_signal|centre-right|points=4||terminal 110
TB-120|terminal_block|control_signal|bottom-left-centre|points=3||terminal 120
TB-130|terminal_block|control_signal|bottom-centre-right|points=2||terminal 130
RECEPT1|connector_receptacle|24VDC|top-right|pins=5;style=M12 micro, female||5 pin receptacle
INFEED1|connector_receptacle|control_signal|centre-bottom|pins=6;style=6-pin mini, female||infeed interface
DISCHARGE1|cable_plug|control_signal|centre-bottom|pins=6;style=6-pin mini, male||discharge interface
TB-IINSP1|terminal_block|control_signal|centre-bottom|||IINSP1 terminal
TB-IINSP2|terminal_block|control_signal|centre-bottom|||IINSP2 terminal
TB-DINSP1|terminal_block|control_signal|centre-bottom|||DINSP1 terminal
TB-DINSP2|terminal_block|control_signal|centre-bottom|||DINSP2 terminal
MXCS-M9|external_drawing|control_signal|off-page|||MXCS-M9
MXCS-M11|external_drawing|control_signal|off-page|||MXCS-M11
MXCS-P9|external_drawing|control_signal|off-page|||MXCS-P9
MXCS-P11|external_drawing|control_signal|off-page|||MXCS-P11
UPSTREAM-MACHINE|external_machine|control_signal|off-page|||previous machine
DOWNSTREAM-MACHINE|external_machine|control_signal|off-page|||next machine
"""

# Component: terminal function net, - where there is no net
TERMINALS = """
PLG1: B line L1, W neutral N, G ground GND
PLG2: B line L1, W neutral N, G ground GND
TB-L1: 1 line L1
TB-N: 1 neutral N
TB-GND-A: 1 ground GND
DISC1: L1 line L1, T1 output L1-A, L2 line -, T2 output -, L3 neutral N, T3 output N-1
CB1: 1 line L1-A, 2 output L1-A1
PS1: L1 line L1-A1, N neutral N-1, GND ground GND, + output +24V, -1 output 0V, -2 output 0V
TB-GND-B: 1 ground GND, 2 ground GND
DOOR-GND: 1 ground GND
EARTH: 1 ground GND, 2 ground GND
CB2: 1 input +24V, 2 output 24E-1
TB-24E1-A: 1 input 24E-1, 2 output 24E-1, 3 output 24E-1, 4 output 24E-1, 5 output 24E-1, 6 output 24E-1, 7 output 24E-1, 8 output 24E-1
TB-24E1-B: 1 input 24E-1, 2 output 24E-1, 3 output 24E-1, 4 output 24E-1, 5 output 24E-1
SPD1: 1 input 24E-1, 2 common 0V, 3 output SPD
TB-SPD: 1 common SPD
REVERSE-CB: 1 input 24E-1, 2 output DIR
TB-DIR: 1 common DIR
PB1: 1 input 24E-1, 2 output PB1-SP, 3 common 0V, 4 output NET-PB1
PB2: 1 input 24E-1, 2 output PB2-SP, 3 common 0V, 4 output NET-PB2
TB-PB1SP: 1 common PB1-SP
TB-PB2SP: 1 common PB2-SP
LT1: BLACK input 24E-1, BLUE common 0V, BROWN input -, WHITE input -
CR1: A1 coil NET-PB1, A2 coil 0V, 11 common 0V, 14 NO_contact 121
CR2: A1 coil NET-PB2, A2 coil 0V, 11 common 121, 14 NO_contact 120
CR-ON: A1 coil 24E-1, A2 coil 110, 11 common 24E-1, 14 NO_contact RUN
CR-BP: A1 coil 24E-1, A2 coil 125, 11 common 111, 12 NC_contact 110, 21 common 24E-1, 24 NO_contact RUN
CR-SW: A1 coil 24E-1, A2 coil 130, 11 common 0V, 14 NO_contact 110
BYPASS-CB: 1 input 120, 2 output 125
TB-RUN: 1 common RUN
TB-110: 1 common 110, 2 common 110, 3 common 110, 4 common 110
TB-120: 1 common 120, 2 common 120, 3 common 120
TB-130: 1 common 130, 2 common 130
TB-0V: 1 common 0V, 2 common 0V, 3 common 0V, 4 common 0V, 5 common 0V, 6 common 0V, 7 common 0V, 8 common 0V, 9 common 0V, 10 common 0V, 11 common 0V, 12 common 0V
RECEPT1: 1 output SPD, 2 output DIR, 3 output RUN, 4 common 0V, 5 output 24E-1
INFEED1: 1 input 110, 2 common 0V, 3 input 120, 4 input 130, 5 input IINSP1, 6 input IINSP2
DISCHARGE1: 1 output 111, 2 common 0V, 3 output 120, 4 output 130, 5 output DINSP1, 6 output DINSP2
TB-IINSP1: 1 common IINSP1
TB-IINSP2: 1 common IINSP2
TB-DINSP1: 1 common DINSP1
TB-DINSP2: 1 common DINSP2
"""

# Net, signal type, nominal voltage
NETS = """
L1,power,115VAC
L1-A,power,115VAC
L1-A1,power,115VAC
N,power,115VAC neutral
N-1,power,115VAC neutral
GND,ground,0V
+24V,power,24VDC
24E-1,power,24VDC
0V,ground,0V
SPD,control,24VDC
DIR,control,24VDC
RUN,control,24VDC
110,control,24VDC
111,control,24VDC
120,control,24VDC
121,control,24VDC
125,control,24VDC
130,control,24VDC
NET-PB1,control,24VDC
NET-PB2,control,24VDC
PB1-SP,control,
PB2-SP,control,
IINSP1,control,
IINSP2,control,
DINSP1,control,
DINSP2,control,
"""

# From, to, colour, gauge, net, cable
WIRES = """
PLG1:B,TB-L1:1,BLACK,10AWG,L1,CABLE-POWER-IN
PLG1:W,TB-N:1,WHITE,10AWG,N,CABLE-POWER-IN
PLG1:G,TB-GND-A:1,GREEN,10AWG,GND,CABLE-POWER-IN
PLG2:B,TB-L1:1,BLACK,10AWG,L1,CABLE-POWER-OUT
PLG2:W,TB-N:1,WHITE,10AWG,N,CABLE-POWER-OUT
PLG2:G,TB-GND-A:1,GREEN,10AWG,GND,CABLE-POWER-OUT
TB-L1:1,DISC1:L1,BLACK,12AWG,L1,
TB-N:1,DISC1:L3,WHITE,12AWG,N,
DISC1:T1,CB1:1,BLACK,12AWG,L1-A,
CB1:2,PS1:L1,BLACK,12AWG,L1-A1,
DISC1:T3,PS1:N,WHITE,12AWG,N-1,
TB-GND-A:1,EARTH:1,,,GND,
DOOR-GND:1,TB-GND-B:1,GREEN,12AWG,GND,
TB-GND-B:2,PS1:GND,GREEN,12AWG,GND,
TB-GND-B:2,EARTH:2,,,GND,
PS1:+,CB2:1,BLUE,12AWG,+24V,
CB2:2,TB-24E1-A:1,BLUE,12AWG,24E-1,
PS1:-1,TB-0V:1,WHITE/BLUE,12AWG,0V,
PS1:-2,TB-0V:2,WHITE/BLUE,12AWG,0V,
TB-24E1-A:2,TB-24E1-B:1,BLUE,12AWG,24E-1,
TB-24E1-A:3,PB1:1,BROWN,22AWG,24E-1,CABLE-PB1-START-STOP
TB-24E1-A:4,PB2:1,BROWN,22AWG,24E-1,CABLE-PB2-START-STOP
TB-24E1-A:5,LT1:BLACK,BLACK,22AWG,24E-1,CABLE-LT1
TB-24E1-A:6,CR-ON:A1,BLUE,18AWG,24E-1,
TB-24E1-A:7,CR-BP:A1,BLUE,18AWG,24E-1,
TB-24E1-A:8,CR-SW:A1,BLUE,18AWG,24E-1,
TB-24E1-B:1,REVERSE-CB:1,BLUE,18AWG,24E-1,
TB-24E1-B:2,SPD1:1,BLUE,18AWG,24E-1,
TB-24E1-B:3,CR-ON:11,BLUE,18AWG,24E-1,
TB-24E1-B:4,CR-BP:21,BLUE,18AWG,24E-1,
TB-24E1-B:5,RECEPT1:5,RED,18AWG,24E-1,
SPD1:3,TB-SPD:1,BLUE,18AWG,SPD,
TB-SPD:1,RECEPT1:1,BROWN,18AWG,SPD,CABLE-RECEPT1
REVERSE-CB:2,TB-DIR:1,BLUE,18AWG,DIR,
TB-DIR:1,RECEPT1:2,GREEN,18AWG,DIR,CABLE-RECEPT1
SPD1:2,TB-0V:3,WHITE/BLUE,18AWG,0V,
TB-0V:4,RECEPT1:4,WHITE,18AWG,0V,CABLE-RECEPT1
PB1:2,TB-PB1SP:1,WHITE,22AWG,PB1-SP,CABLE-PB1-START-STOP
PB1:3,TB-0V:5,BLUE,22AWG,0V,CABLE-PB1-START-STOP
PB1:4,CR1:A1,BLACK,22AWG,NET-PB1,CABLE-PB1-START-STOP
PB2:2,TB-PB2SP:1,WHITE,22AWG,PB2-SP,CABLE-PB2-START-STOP
PB2:3,TB-0V:6,BLUE,22AWG,0V,CABLE-PB2-START-STOP
PB2:4,CR2:A1,BLACK,22AWG,NET-PB2,CABLE-PB2-START-STOP
LT1:BLUE,TB-0V:7,BLUE,22AWG,0V,CABLE-LT1
CR1:A2,TB-0V:8,WHITE/BLUE,18AWG,0V,
CR2:A2,TB-0V:9,WHITE/BLUE,18AWG,0V,
CR-ON:A2,TB-110:3,BLUE,18AWG,110,
CR-BP:A2,BYPASS-CB:2,BLUE,18AWG,125,
CR-SW:A2,TB-130:1,BLUE,18AWG,130,
TB-0V:10,CR1:11,WHITE/BLUE,18AWG,0V,
CR1:14,CR2:11,BLUE,18AWG,121,
CR2:14,TB-120:1,BLUE,18AWG,120,
TB-120:3,BYPASS-CB:1,BLUE,18AWG,120,
CR-ON:14,TB-RUN:1,BLUE,18AWG,RUN,
CR-BP:24,TB-RUN:1,BLUE,18AWG,RUN,
TB-RUN:1,RECEPT1:3,BLACK,18AWG,RUN,CABLE-RECEPT1
TB-0V:11,CR-SW:11,WHITE/BLUE,18AWG,0V,
CR-SW:14,TB-110:1,BLUE,18AWG,110,
INFEED1:1,TB-110:2,BLUE,16AWG,110,CABLE-INFEED1
CR-BP:12,TB-110:4,BLUE,18AWG,110,
DISCHARGE1:1,CR-BP:11,BLUE,16AWG,111,CABLE-DISCHARGE1
INFEED1:2,TB-0V:12,GREEN,16AWG,0V,CABLE-INFEED1
INFEED1:3,TB-120:2,RED,16AWG,120,CABLE-INFEED1
INFEED1:4,TB-130:2,ORANGE,16AWG,130,CABLE-INFEED1
INFEED1:5,TB-IINSP1:1,BLACK,16AWG,IINSP1,CABLE-INFEED1
INFEED1:6,TB-IINSP2:1,WHITE,16AWG,IINSP2,CABLE-INFEED1
DISCHARGE1:2,TB-0V:12,GREEN,16AWG,0V,CABLE-DISCHARGE1
DISCHARGE1:3,TB-120:2,RED,16AWG,120,CABLE-DISCHARGE1
DISCHARGE1:4,TB-130:2,ORANGE,16AWG,130,CABLE-DISCHARGE1
DISCHARGE1:5,TB-DINSP1:1,BLACK,16AWG,DINSP1,CABLE-DISCHARGE1
DISCHARGE1:6,TB-DINSP2:1,WHITE,16AWG,DINSP2,CABLE-DISCHARGE1
"""

# Cables and subsystems
CABLES = "CABLE-POWER-IN CABLE-POWER-OUT CABLE-PB1-START-STOP CABLE-PB2-START-STOP CABLE-LT1 CABLE-RECEPT1 CABLE-INFEED1 CABLE-DISCHARGE1".split()
SUBSYSTEMS = """
SUB-115VAC-INPUT: PLG1 PLG2 TB-L1 TB-N TB-GND-A DISC1 CB1
SUB-24VDC-SUPPLY: PS1 CB2 TB-GND-B DOOR-GND EARTH TB-24E1-A TB-24E1-B TB-0V
SUB-OPERATOR-CONTROL: PB1 PB2 TB-PB1SP TB-PB2SP CR1 CR2 LT1 TB-120
SUB-BYPASS: BYPASS-CB CR-BP
SUB-RUN-CONTROL: CR-ON CR-SW TB-RUN TB-110 TB-130
SUB-SPEED-DIRECTION: SPD1 TB-SPD REVERSE-CB TB-DIR
SUB-MACHINE-INTERFACE: RECEPT1 INFEED1 DISCHARGE1 TB-IINSP1 TB-IINSP2 TB-DINSP1 TB-DINSP2
"""

# Type, source, target of the edges that the tables don't imply
EDGES = """
POWERS PS1 24E-1
POWERS PS1 0V
POWERS PLG1 L1
POWERS TB-L1 PLG2
POWERS 24E-1 SPD1
POWERS 24E-1 LT1
POWERS 24E-1 RECEPT1
PROTECTS CB1 PS1
PROTECTS CB2 24E-1
PROTECTS DISC1 SUB-24VDC-SUPPLY
ACTUATES PB1 CR1
ACTUATES PB2 CR2
ACTUATES BYPASS-CB CR-BP
ACTUATES REVERSE-CB DIR
ACTUATES DOWNSTREAM-MACHINE CR-SW
COIL_CONTROLS_CONTACT CR1 CR1:14
COIL_CONTROLS_CONTACT CR2 CR2:14
COIL_CONTROLS_CONTACT CR-ON CR-ON:14
COIL_CONTROLS_CONTACT CR-BP CR-BP:24
COIL_CONTROLS_CONTACT CR-BP CR-BP:12
COIL_CONTROLS_CONTACT CR-SW CR-SW:14
ACTUATES 110 CR-ON
GROUNDED_TO TB-GND-A EARTH
GROUNDED_TO TB-GND-B EARTH
GROUNDED_TO PS1 EARTH
REFERENCES PS20115MLM4-2 MXCS-M9
REFERENCES PS20115MLM4-2 MXCS-M11
REFERENCES PS20115MLM4-2 MXCS-P9
REFERENCES PS20115MLM4-2 MXCS-P11
REFERENCES RECEPT1 MXCS-P9
REFERENCES INFEED1 UPSTREAM-MACHINE
REFERENCES DISCHARGE1 DOWNSTREAM-MACHINE
"""


def _lines(text: str) -> list[str]:
    return text.strip().split("\n")


def authored(spark: SparkSession) -> dict[str, DataFrame]:
    """The tables as they are written down; nets have no members and cables no wires yet."""
    components = []
    for ord_, line in enumerate(_lines(COMPONENTS), 1):
        cid, cls, domain, zone, ratings, part, aliases = line.split("|")
        pairs = [tuple(r.split("=", 1)) for r in ratings.split(";") if r]
        components.append((cid, cls, f"{cls.replace('_', ' ').capitalize()} {cid} of the power supply sheet.", pairs, domain, zone, part or None, [a for a in aliases.split(";") if a], ord_))
    terminals = []
    for line in _lines(TERMINALS):
        component, points = line.split(": ")
        terminals += [(component, *(None if x == "-" and k == 2 else x for k, x in enumerate(p.split(" ")))) for p in points.split(", ")]
    wires = [tuple(x or None for x in line.split(",")) for line in _lines(WIRES)]
    nets = [tuple(x or None for x in line.split(",")) for line in _lines(NETS)]
    subsystems = [(s, members.split(" ")) for s, members in (line.split(": ") for line in _lines(SUBSYSTEMS))]
    edges = [tuple(line.split(" ")) for line in _lines(EDGES)]
    frame = spark.createDataFrame
    number = lambda rows: [(*r, k) for k, r in enumerate(rows, 1)]
    return {
        "drawing": frame([DRAWING], "drawing_number string, revision string, title string, date string, assembly string, references array<string>, notes array<string>"),
        "components": frame(components, "id string, class string, description string, ratings array<struct<k:string,v:string>>, power_domain string, zone string, part_number string, aliases array<string>, ord int"),
        "terminals": frame(number(terminals), "component string, terminal string, function string, net string, ord int"),
        "nets": frame(number(nets), "id string, signal_type string, nominal_voltage string, ord int"),
        "wires": frame(number(wires), "from_terminal string, to_terminal string, color string, gauge string, net string, cable string, ord int"),
        "cables": frame(number([(c,) for c in CABLES]), "id string, ord int"),
        "subsystems": frame(number(subsystems), "id string, member_components array<string>, ord int"),
        "edges": frame(number(edges), "type string, src string, tgt string, ord int"),
    }
