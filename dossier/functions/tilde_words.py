"""Words whose accented vowel the scanner writes as ``~``, with the repaired spelling."""

TILDE_WORDS: dict[str, str] = {
    "n~mero": "número",
    "m~xico": "méxico",
    "p~blico": "público",
    "inscripci~n": "inscripción",
    "manifestaci~n": "manifestación",
    "declaraci~n": "declaración",
    "administraci~n": "administración",
    "denominaci~n": "denominación",
    "constituci~n": "constitución",
    "an~nima": "anónima",
    "cl~usula": "cláusula",
    "cl~usulas": "cláusulas",
    "trav~s": "través",
    "d~cimo": "décimo",
    "vig~simo": "vigésimo",
    "trig~simo": "trigésimo",
    "s~ptimo": "séptimo",
    "t~rmino": "término",
    "t~rminos": "términos",
    "ap~ndice": "apéndice",
    "participaci~n": "participación",
    "car~cter": "carácter",
    "p~rdida": "pérdida",
    "cr~dito": "crédito",
    "pr~stamos": "préstamos",
    "dem~s": "demás",
    "ser~n": "serán",
    "s~lo": "sólo",
    "c~dula": "cédula",
    "c~dulas": "cédulas",
    "trat~ndose": "tratándose",
    "diecis~is": "dieciséis",
    "duraci~n": "duración",
    "t~cnicos": "técnicos",
    "intermediaci~n": "intermediación",
    "colocaci~n": "colocación",
    "jim~nez": "jiménez",
    "s~nchez": "sánchez",
    "adquisici~n": "adquisición",
    "notificaci~n": "notificación",
    "resoluci~n": "resolución",
    "petici~n": "petición",
    "secci~n": "sección",
    "admisi~n": "admisión",
    "designaci~n": "designación",
    "acci~n": "acción",
    "despu~s": "después",
    "estar~n": "estarán",
    "deber~n": "deberán",
    "podr~n": "podrán",
    "tendr~n": "tendrán",
    "firmar~n": "firmarán",
    "observar~n": "observarán",
    "est~n": "están",
    "teni~ndose": "teniéndose",
    "expres~ndose": "expresándose",
    "econ~micas": "económicas",
    "v~lidamente": "válidamente",
    "claus~ra": "clausura",
    "m~<ico": "méxico",
    "reducci6~n": "reducción",
}
