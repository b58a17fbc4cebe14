"""Term tables, their loaders and the fixed values of the text operators."""

from __future__ import annotations

from collections.abc import Iterable

#: Marks around a placeholder's number, and what they travel as through a backend.
OPEN, CLOSE = "⟦", "⟧"
WIRE_OPEN, WIRE_CLOSE = "[[", "]]"

# Limits that results depend on.
TAB_STOP = 8
MAX_JUSTIFICATION = 3
COLLAPSE_PASSES = 5
DEEP_INDENT, DEEP_RATIO, SYNTAX_RATIO = 4, 0.15, 0.5
COLUMN_GAP, COLUMN_ROWS = 2, 3
PROSE_DENSITY, PROSE_WORDS = 0.14, 8
MIN_LENGTH_RATIO, MAX_LENGTH_RATIO = 0.5, 2.5
MAX_QUOTED_WORDS = 3
MIN_WIDTH, DEFAULT_WIDTH = 40, 80
PIPELINE_VERSION, CACHE_FORMAT = 5, 1
UNKNOWN_MARKS = ("⁇", "<unk>", "�")
DELIMITERS = "[]{}()"
SYNTAX_SECTIONS = ("SYNOPSIS", "COMMAND SYNOPSIS", "SYNTAX")
SHELL_CHARACTERS = "{}|=^@`\\~$<>*[]&;%#"
PROSE_CHARACTERS = "•©‐–—“”‘’…§¶«»°±×÷"
SIZE_BUCKETS = ((1, 10), (11, 25), (26, 50), (51, 100), (101, 200), (201, 400), (401, None))
THRESHOLDS = (0.75, 0.78, 0.80, 0.83, 0.85, 0.88, 0.90)

# Function words by which English prose is known.
FUNCTION_WORDS = """
a an the
of to in for with on at by from as into over under through about against
is are was were be been being am
do does did done
has have had having
will would can could may might must shall should
and or but nor if then than that this these those it its
not no so such
when where which who whom while after before between during until since
each other some any all both more most only same too very
you your they their them
there here what how why
"""

# Last labels of dotted names.
EXTENSIONS = """
service socket device mount automount swap target path timer slice scope network netdev link image
conf cnf cfg ini json yaml yml toml xml rules desktop list lock spec
sh bash zsh py pl rb js ts go rs cpp hpp awk sed
tar tgz gz xz bz2 zst zip iso img deb rpm
txt md log csv tsv sql db sqlite html htm pdf out bak tmp orig patch diff man
pem key crt csr gpg asc pub
com org net edu gov mil int info biz io dev app br uk de fr nl jp cn ru eu us
"""

# Terms that are never translated.
KEPT_TERMS = """
non-headless
headless
"""

# Produced term and wanted term.
GLOSSARY = """
tomada\tsocket
tomadas\tsockets
soquete\tsocket
soquetes\tsockets
concha\tshell
conchas\tshells
casca\tshell
bandeira\tflag
bandeiras\tflags
anfitrião\thost
anfitriões\thosts
hospedeiro\thost
hospedeiros\thosts
cano\tpipe
canos\tpipes
tubo\tpipe
tubos\tpipes
tubulação\tpipeline
condutor\tdriver
condutores\tdrivers
motorista\tdriver
motoristas\tdrivers
corda\tstring
cordas\tstrings
fio\tthread
fios\tthreads
duende\tdaemon
duendes\tdaemons
demónio\tdaemon
demônio\tdaemon
demônios\tdaemons
"""

# Section header and its translation.
HEADERS = """
NAME\tNOME
SYNOPSIS\tSINOPSE
DESCRIPTION\tDESCRIÇÃO
OPTIONS\tOPÇÕES
EXAMPLES\tEXEMPLOS
FILES\tARQUIVOS
ENVIRONMENT\tAMBIENTE
EXIT STATUS\tSTATUS DE SAÍDA
RETURN VALUE\tVALOR DE RETORNO
SEE ALSO\tVEJA TAMBÉM
BUGS\tBUGS
AUTHOR\tAUTOR
AUTHORS\tAUTORES
COPYRIGHT\tDIREITOS AUTORAIS
HISTORY\tHISTÓRICO
NOTES\tNOTAS
CAVEATS\tRESSALVAS
REPORTING BUGS\tRELATANDO BUGS
DIAGNOSTICS\tDIAGNÓSTICOS
CONFORMING TO\tEM CONFORMIDADE COM
STANDARDS\tPADRÕES
AVAILABILITY\tDISPONIBILIDADE
COMMANDS\tCOMANDOS
CONFIGURATION\tCONFIGURAÇÃO
SECURITY\tSEGURANÇA
COMPATIBILITY\tCOMPATIBILIDADE
NOTE\tNOTA
USAGE\tUSO
VARIABLES\tVARIÁVEIS
TARGETS\tALVOS
TABLES\tTABELAS
PROTOCOLS\tPROTOCOLOS
OUTPUT\tSAÍDA
GENERAL\tGERAL
SETUP\tCONFIGURAÇÃO INICIAL
OPTIONS SUMMARY\tRESUMO DAS OPÇÕES
COMMAND SYNOPSIS\tSINOPSE DO COMANDO
SOURCE OPTIONS\tOPÇÕES DE ORIGEM
SIMPLE PROCESS SELECTION\tSELEÇÃO SIMPLES DE PROCESSOS
PROCESS SELECTION BY LIST\tSELEÇÃO DE PROCESSOS POR LISTA
SETUID AND SETGID BITS\tBITS SETUID E SETGID
OVERVIEW\tVISÃO GERAL
INTRODUCTION\tINTRODUÇÃO
ARGUMENTS\tARGUMENTOS
OPERANDS\tOPERANDOS
EXIT CODES\tCÓDIGOS DE SAÍDA
ERRORS\tERROS
WARNINGS\tAVISOS
LIMITATIONS\tLIMITAÇÕES
IMPLEMENTATION NOTES\tNOTAS DE IMPLEMENTAÇÃO
PORTABILITY\tPORTABILIDADE
DEPENDENCIES\tDEPENDÊNCIAS
INSTALLATION\tINSTALAÇÃO
REQUIREMENTS\tREQUISITOS
LICENSE\tLICENÇA
ACKNOWLEDGEMENTS\tAGRADECIMENTOS
Usage:\tUso:
USAGE:\tUSO:
Options:\tOpções:
OPTIONS:\tOPÇÕES:
Flags:\tOpções:
FLAGS:\tOPÇÕES:
Commands:\tComandos:
COMMANDS:\tCOMANDOS:
Arguments:\tArgumentos:
ARGUMENTS:\tARGUMENTOS:
Examples:\tExemplos:
EXAMPLES:\tEXEMPLOS:
Global Options:\tOpções globais:
Global Flags:\tOpções globais:
Common Commands:\tComandos comuns:
Management Commands:\tComandos de gerenciamento:
Positional Arguments:\tArgumentos posicionais:
POSITIONAL ARGUMENTS:\tARGUMENTOS POSICIONAIS:
INPUT:\tENTRADA:
OUTPUT:\tSAÍDA:
CONFIGURATION:\tCONFIGURAÇÃO:
DEBUG:\tDEPURAÇÃO:
FILTER:\tFILTRO:
UPDATE:\tATUALIZAÇÃO:
"""


class TermError(ValueError):
    """A line of a term table that cannot be read."""


def _entries(text: str) -> Iterable[tuple[int, str]]:
    for number, line in enumerate(text.split("\n"), 1):
        entry = line.partition("#")[0].strip()
        if entry:
            yield number, entry


def pairs(text: str, *, lower: bool = False) -> dict[str, str]:
    """TAB-separated pairs; `#` starts a comment; a missing tab or an empty side is an error."""
    table = {}
    for number, entry in _entries(text):
        left, tab, right = (part.strip(" ") for part in entry.partition("\t"))
        if not tab or not left or not right.strip():
            raise TermError(f"line {number}: two sides with a tab between them are needed")
        table[left.strip().lower() if lower else left.strip()] = right.strip()
    return table


def terms(text: str, least: int) -> list[str]:
    """Terms by falling length; a term shorter than `least` is an error."""
    found = []
    for number, entry in _entries(text):
        for term in entry.split():
            if len(term) < least:
                raise TermError(f"line {number}: {term!r} is too short")
            found.append(term)
    return sorted(dict.fromkeys(found), key=len, reverse=True)


def extensions(text: str = EXTENSIONS) -> list[str]:
    return terms(text, 2)


def kept_terms(text: str = KEPT_TERMS) -> list[str]:
    found = []
    for number, entry in _entries(text):
        if len(entry) < 3:
            raise TermError(f"line {number}: {entry!r} is too short")
        found.append(entry)
    return sorted(dict.fromkeys(found), key=len, reverse=True)


def function_words(text: str = FUNCTION_WORDS) -> list[str]:
    return sorted({w.lower() for _, entry in _entries(text) for w in entry.split()})


def glossary(text: str = GLOSSARY) -> dict[str, str]:
    return pairs(text, lower=True)


def headers(text: str = HEADERS) -> dict[str, str]:
    return pairs(text)
