"""Fixed values of the linkage domain, stated plainly: word lists, marks, prefixes, codes."""

# Whole-token abbreviations; those of the configuration win over the extra ones.
ABBREVIATIONS_EXTRA = {
    "DISJ": "DISJUNTOR", "SECC": "SECCIONADORA", "SECCION": "SECCIONADORA", "TRAFO": "TRANSFORMADOR", "TRANSF": "TRANSFORMADOR", "REL": "RELE",
    "CDC": "COMUTADOR DERIVACAO CARGA", "COMUT": "COMUTADOR", "MOLA": "BOBINA", "TENS": "TENSAO", "CORR": "CORRENTE", "POT": "POTENCIA",
    "TEMP": "TEMPERATURA", "PRESS": "PRESSAO", "BLOQ": "BLOQUEIO", "SINAL": "SINALIZACAO", "SINALIZ": "SINALIZACAO", "ALARM": "ALARME",
    "OPER": "OPERACAO", "MAN": "MANUAL", "AUT": "AUTOMATICO", "DIFER": "DIFERENCIAL",
    "SOBREC": "SOBRECORRENTE", "RELIG": "RELIGADOR", "MEDIC": "MEDICAO", "SUCEDIDO": "SUCESSO",
}
ABBREVIATIONS = {
    "DISJ": "DISJUNTOR", "DJ": "DISJUNTOR", "SECC": "SECCIONADORA", "SEC": "SECCIONADORA", "TR": "TRANSFORMADOR", "TRAFO": "TRANSFORMADOR",
    "LT": "LINHA TRANSMISSAO", "AL": "ALIMENTADOR", "BC": "BANCO CAPACITORES", "PROT": "PROTECAO",
}
STOPWORDS = ("DE", "DA", "DO", "DOS", "DAS", "E", "O", "A", "OS", "AS", "EM", "NO", "NA")
UNITS = {"KV": "KV", "KVA": "KVA", "MVA": "MVA", "MW": "MW", "MVAR": "MVAR", "A": "A", "AMP": "A", "AMPERE": "A", "AMPERES": "A", "V": "V", "HZ": "HZ", "C": "C"}
EQUIPMENT_TERMS = ("DISJUNTOR", "SECCIONADORA", "TRANSFORMADOR", "RELIGADOR", "RELE", "CHAVE", "BANCO", "ALIMENTADOR", "LINHA")
EQUIPMENT_WORDS = {"DISJUNTOR": "Disjuntor", "DISJ": "Disjuntor", "DJ": "Disjuntor", "SECCIONADORA": "Seccionadora", "SECCION": "Seccionadora", "SECC": "Seccionadora"}
EQUIPMENT_NUMBERS = {"52": "Disjuntor", "24": "Disjuntor", "89": "Seccionadora", "29": "Seccionadora"}
SIDES = ("AT", "BT")
BUS = {"P": "Principal", "A": "Auxiliar"}
PHASES = ("ABC", "AB", "BC", "CA", "A", "B", "C", "N")
PHASE_PAIRS = {"AC": "CA", "BA": "AB", "CB": "BC"}
PHASE_WORDS = {"NEUTRO": "N", "TRIFASICO": "ABC", "TRIFASICA": "ABC"}

# The type vocabulary.
TYPE_CODES = {
    "A": ("Analog", "Input"), "C": ("Discrete", "Output"), "D": ("Discrete", "Input"), "A/D": ("DiscreteAnalog", "Input"),
    "AI": ("Analog", "Input"), "AO": ("Analog", "Output"), "DI": ("Discrete", "Input"), "DO": ("Discrete", "Output"),
}
TYPE_ANALOG = ("ANALOGIC", "MEDIDA", "MEDICAO", "GRANDEZA")
TYPE_COMMAND = ("COMANDO", "CONTROLE", "TELECOMANDO")
TYPE_DISCRETE = ("DIGITAL", "DIGITAIS", "DISCRET", "SINALIZ", "STATUS", "ESTADO", "INDICAC")

# State lexicon, (beginning of a token, class, polarity), in order.
STATES = (
    ("FECHA", "POSICAO", "A"), ("LIGA", "POSICAO", "A"), ("ABERT", "POSICAO", "B"), ("ABRIR", "POSICAO", "B"), ("DESLIGA", "POSICAO", "B"),
    ("INCLUI", "FUNCAO", None), ("EXCLUI", "FUNCAO", None), ("ATIVA", "ATIVACAO", None), ("DESATIVA", "ATIVACAO", None),
    ("HABILITA", "ATIVACAO", None), ("DESABILITA", "ATIVACAO", None), ("REMOT", "LOCAL_REMOTO", None), ("ATUAD", "EVENTO", None),
    ("FALHA", "EVENTO", None), ("DEFEITO", "EVENTO", None), ("FALTA", "EVENTO", None), ("BLOQUE", "EVENTO", None), ("LIBERA", "EVENTO", None),
    ("INDEFINID", "INDEFINIDO", None),
)
STATE_TOKENS = {"LOCAL": "LOCAL_REMOTO"}
ON_PREFIXES, OFF_PREFIXES = ("LIGAD", "FECHAD"), ("DESLIGAD", "ABERT")
OPENING, CLOSING = ("ABRIR", "ABERT", "DESLIGA"), ("FECHA", "LIGA")
ON_WORDS, OFF_WORDS = ("LIGADO", "LIGADA", "FECHADO", "FECHADA"), ("DESLIGADO", "DESLIGADA", "ABERTO", "ABERTA")
DISCONNECTORS = (
    ("BYPASS", "SECB"), ("BY", "SECB"), ("CARG", "SECC"), ("TRANSFER", "SECT"), ("ATERR", "SECG"), ("TERRA", "SECG"), ("FONT", "SECF"),
    ("INTERBAR", "SECI"), ("INTERLINHA", "SECL"),
)
POSITION_CODES = ("DJF1", "DJA1", "SECC", "SECB", "SECT", "SECG", "SECF", "SECI", "SECL")

# Rules and filters.
PROTECTION_NUMBERS = ("21", "25", "27", "32", "37", "40", "46", "47", "49", "50", "51", "55", "59", "67", "78", "79", "81", "85", "86", "87")
OPPOSITES = (
    ("sobrecorrente_x_subcorrente", ("SOBRECORRENTE", "SOBRE"), ("SUBCORRENTE", "SUB"), ("50", "51", "67", "37SOBRE"), ("37",)),
    ("sobretensao_x_subtensao", ("SOBRETENSAO", "59"), ("SUBTENSAO", "27"), ("59",), ("27",)),
    ("tap_max_x_min", ("MAX", "MAXIMO"), ("MIN", "MINIMO"), ("MAX",), ("MIN",)),
    ("ligado_x_desligado", ("LIGADO", "LIGAR"), ("DESLIGADO", "DESLIGAR"), ("LIGADO", "LIGAR", "LIG"), ("DESLIGADO", "DESLIGAR", "DESLIG")),
    ("barra_x_linha", ("BARRA",), ("LINHA",), ("_B", "BARRA"), ("_L", "LINHA")),
)
COMMAND_TOKENS = ("LIGAR", "DESLIGAR", "COMANDO", "CONTROLE", "ABRIR", "FECHAR", "CMD")
COMMAND_MARKS, STRICT_COMMAND_MARKS = ("CMD", "_CMD", "COM", "_C"), ("CMD", "_CMD", "_C")
STAGES = ("E1", "E2", "E3", "E4")
SIDE_WORDS = {"PRIMARIO": "AT", "PRIMARIA": "AT", "ALTA": "AT", "AT": "AT", "SECUNDARIO": "BT", "SECUNDARIA": "BT", "BAIXA": "BT", "BT": "BT"}
SIDE_MARKS = {"AT": ("AT", "_AT", "PRIM"), "BT": ("BT", "_BT", "SEC")}
SF6_LOCK = ("SF6B", "SFAB", "SFFC")
GENERAL_LOCK = ("86", "86BF", "86AT", "86BT")
BREAKER_FAIL_LOCK = ("BFAT", "BFBT", "BFP1", "BFP2", "BFP3", "62BF")
RULE_WEIGHTS = {"number": 0.10, "opposites": 0.15, "phase": 0.10, "stage": 0.10, "command": 0.08, "equipment": 0.12, "side": 0.08, "state": 0.15, "direction": 0.10}

# Output vocabulary.
MEASUREMENTS = {
    "CORRENTE": "Current", "TENSÃO": "Voltage", "POTÊNCIA ATIVA": "ActivePower", "POTÊNCIA REATIVA": "ReactivePower", "TEMPERATURA": "Temperature",
    "COMPRIMENTO": "Unitless", "FREQUÊNCIA": "Frequency", "FATOR DE POTÊNCIA": "CosPhi", "POTÊNCIA APARENTE": "ApparentPower",
    "ÂNGULO DE TENSÃO": "VoltageAngle", "UMIDADE": "Humidity", "DISCRETO": "Discrete",
}
ANALOG_SIGNALS = {"VALOR MEDIDO": "MeasuredValue", "GRAVADOR DE FALHA": "FaultRecorder", "CONTAGEM DE OPERAÇÃO": "Custom"}
PHASE_CODES = ("ABC", "AB", "BC", "AC", "A", "B", "C", "N")
FAMILY_SUFFIXES = {"Disjuntor": "DJ", "Seccionadora": "SEC", "Transformador": "TR"}
RELAY_CODES = ("21", "25IE", "27", "27E1", "27E2", "51N", "59", "67", "81", "87", "SGF", "2649")
CURRENT_MEASURES, VOLTAGE_MEASURES = ("CORRENTE", "POTÊNCIA ATIVA", "POTÊNCIA REATIVA", "POTÊNCIA APARENTE"), ("TENSÃO",)
