"""Template residue, filler, error pages and demands for scripts among real text.

Labelled exemplars of residue are indexed by their word stems. An exemplar is a message with slots: a slot is one word
or several that stand for it, so that a message in new wording retrieves it, too. Every passage window (line, sentence,
paragraph) retrieves the exemplars whose telling words it holds; it is residue when the exemplars of one class contain
enough of its TF-IDF mass. Unfilled fields of templates, codes, paths, mock Latin and words that only repeat are words
of the index like any other.
"""

from __future__ import annotations

import itertools
import math
import operator
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Collection, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Share of a window's mass that exemplars must contain.
COVERAGE = 0.6
#: Share of an exemplar's own mass that a window must hold.
HELD = 0.5
#: Words that are scored at once; longer passages are covered by windows that overlap by half.
WIDTH = 60

# fixed values: labelled exemplars by class. Words are slots, alternatives are set apart by |; a slot with ! must be held, one with ? may be.
# <0> figure, <ruta> path, <codigo> what only machines write, <clave> letters with figures, <campo> unfilled field, <latín> mock Latin, <eco> a word that repeats itself
EXEMPLARS: dict[str, list[str]] = {
    "plantilla": ["!<campo>"],
    "relleno": [
        "!<latín> ?sit ?dolor ?dolore ?et ?ut ?sed ?non ?do ?eiusmod ?incididunt ?labore ?magna ?enim ?ad ?minim ?quis ?nostrud ?ex ?ea ?commodo ?duis ?aute ?irure ?eu ?fugiat ?sint ?id ?est",
        "!<eco>",
        "!relleno|muestra|ejemplo|demostración|ficticio !texto|párrafo|contenido|datos|título|documento|página ?número ?<0> ?temporal ?este ?aún ?todavía ?parte ?artículo ?norma ?anexo ?nota ?encabezado ?título ?considerandos ?resolutiva ?vigencia ?técnico",
        "!texto|párrafo|contenido|sección|apartado|página !provisional|temporal|sustituirá|reemplazará|sustituirse|reemplazarse|sustituido|reemplazado|sustituir|reemplazar|reemplace|sustituya|cambiará|borrar|borre|eliminar ?oficina ?editora|editor|redacción|equipo ?entregue|envíe|publique|remita versión|publicar|definitivo|final|oficial ?antes ?cuando ?luego ?después",
        "!aquí|acá|espacio|recuadro|hueco va|vendrá|irá|aparecerá|escriba|escribir|inserte|insertar|coloque|colocar|pegue|pegar|redacte|introduzca|ingrese ?texto|contenido|resumen|cuerpo|título|encabezado|considerandos|epígrafe|firma|fecha ?publicar",
        "!pendiente|falta|faltan !digitar|digitación|transcribir|redactar|completar|diligenciar|cargar|insertar|publicar ?texto ?contenido ?parte ?artículo ?norma ?anexo ?nota ?encabezado ?título ?considerandos ?resolutiva ?vigencia ?técnico",
        "!contenido|sección|página !pendiente|construcción|elaboración|desarrollo|preparación ?digitación|revisión ?edición",
        "!todo|fixme|tbd|pendiente !cargar|completar|revisar|escribir|actualizar|corregir|definir|agregar|redactar ?texto ?contenido ?antes ?publicar ?parte ?artículo ?norma ?anexo ?nota ?encabezado ?título ?considerandos ?resolutiva ?vigencia ?técnico",
        "!antes !publicar|publicación|lanzar !reemplazar|borrar|completar|cargar|sustituir|texto|contenido|revisar ?prueba|relleno|muestra|ejemplo",
        "!contenido|texto|página|documento !prueba|pruebas|test|demo|muestra reemplazar|borrar|publicar|ignorar|eliminar|sustituir ?antes ?favor",
        "!etcétera|blablá|bla texto|etcétera|blablá|bla|bla|más",
        "!próximamente|coming|soon disponible|soon|próximamente|página|contenido",
        "!sample|dummy|filler|example|placeholder|demo text|paragraph|content|title|data|copy ?this ?here ?for ?page ?goes",
        "!placeholder ?texto ?contenido ?imagen ?nombre ?antes ?publicar ?parte ?artículo ?norma ?anexo ?nota ?encabezado ?título ?considerandos ?resolutiva ?vigencia ?técnico",
        "!text|content|title|name|headline|message !here|goes ?add ?write ?insert ?replace",
        "!replace|remove|delete|insert|edit|add this|your text|content|paragraph|copy|title before|here|publishing|launch",
    ],
    "error": [
        "!error <0>|<clave>|<codigo>|interno|fatal|inesperado|crítico|desconocido|servidor|conexión|sistema ?código ?http ?estado",
        "<0> !found|forbidden|unauthorized|gateway|request|timeout|unavailable|gone|timeout|conflict|teapot ?not ?page ?bad ?service ?time ?out ?time-out ?error ?document ?resource",
        "<0> !internal|bad|service server|request|gateway|unavailable|error ?time ?out",
        "!access|permission|forbidden|authorized denied|restricted|forbidden|permission|access|view|authorized ?you ?not ?page ?resource ?this ?server ?<ruta>",
        "!acceso denegado|prohibido|restringido|rechazado ?recurso|página|contenido ?usted ?permisos|permiso|autorizado",
        "!permisos|autorización|privilegios|autorizado !ver|acceder|visualizar|abrir|consultar página|contenido|recurso|sitio|sección|archivo ?suficientes ?tiene ?usted",
        "!reference|incident|request|trace|ray|correlation|support id|<clave>|<codigo>|<0>|number|code",
        "!identificador|código|referencia|número|radicado !incidente|error|fallo|ticket <clave>|<codigo>|<0>",
        "requested|page|url|resource|file|document !found|exist|available|unavailable|served|moved|removed|deleted|loaded|retrieved|located ?server ?this ?was ?not ?temporarily ?could ?be ?<ruta> ?looking ?longer ?sorry ?can ?find",
        "!apache|nginx|iis|tomcat|openresty|litespeed|varnish|squid|cloudflare server|port|<0>|<clave>|cache|gateway",
        "!página|sitio|url|dirección|enlace|recurso|portal|vínculo|web|documento|contenido !solicitada|solicitado|busca|buscada|pedida|requerida|intenta|pide|consultada !existe|encontrada|encontrado|encontró|encuentra|disponible|hallada|localizar|responde|accesible|eliminada ?acceder ?ya ?ver ?documento ?sentimos",
        "!página|sitio|url|dirección|enlace|recurso|portal|vínculo|web !existe|encontrada|encontrado|encontró|encuentra|disponible|hallada|localizar|responde|accesible|caído|roto|inaccesible ?ya ?esta ?temporalmente|momento",
        "!recurso|página|enlace|contenido|dirección|archivo|vínculo|documento !movido|movida|trasladado|trasladada|reubicado|retirado|retirada|roto|rota|cambió|cambiado eliminado|eliminada|borrado|borrada|retirado|retirada|dirección|lugar|existe ?servidor ?posiblemente ?pudo",
        "no !encontramos|encontrado|hallamos|localizamos|ubicamos|hay !busca|buscaba|buscado|solicita|pide|pidió|necesita|quiere ?página|documento|recurso|contenido|archivo ?pudimos",
        "!archivo|documento|fichero|adjunto|pdf|imagen !dañado|corrupto|corrompido|ilegible|incompleto|vacío|bloqueado abrir|abrirse|leer|leerse|descargar|mostrar|reparar|cargar ?pudo ?puede ?<ruta>",
        "!servidor|sistema|sitio|portal|aplicación|aplicativo|plataforma|backend|servicio pudo|puede|logró|consiguió|pude !completar|procesar|atender|responder|cargar|ejecutar|entregar|contestar|responde|respondió ?petición|solicitud|operación|página|consulta|tiempo",
        "!algo salió|anduvo|fue|funcionó|rompió|falló|dañó|va !mal|rompió|falló|dañó|lado|cargar|mostrar|nuestro ?norma|página|documento|contenido ?estamos ?arreglando|revisando",
        "!something|things went|broke|gone|happened !wrong|broke|bad|side|end ?our ?please ?again ?we ?working ?fixing ?it",
        "no !pudimos|logramos|posible|conseguimos|podemos|imposible !mostrar|mostrarle|abrir|recuperar|visualizar|desplegar|cargar|obtener|descargar documento|norma|página|contenido|archivo|providencia|texto|información|resultados ?momento ?solicitado",
        "!error|problema|falla|fallo|excepción|inconveniente !ocurrió|ocurrido|presentó|presentado|produjo|producido|sucedió|detectó|hubo|inesperado|interno|técnico|hay ?procesar|cargar|mostrar|abrir ?servidor|sistema|página ?solicitud|petición ?nuestro ?intente",
        "!internal|unexpected|server|database|network|unknown !error|failure|exception|problem ?occurred ?server ?an ?has ?please ?try ?again",
        "!sentimos|lamentamos|disculpe|disculpas|perdón|ups|uy|oops|vaya|atención página|documento|dirección|problema|mal|inconveniente|molestias|contenido|servicio|sitio|error|encontramos|disponible ?causadas|ocasionadas|causados ?pudimos ?mostrar ?salió ?cargar ?ya ?algo",
        "!intente|intentar|inténtelo|inténtalo|vuelva|reintente|espere !tarde|minutos|nuevamente|nuevo|intentarlo|intentar|otra|momento|instantes|segundos|después|luego ?más ?vez ?por ?favor ?unos",
        "!try !again|later|refresh|reload ?please ?few ?minutes ?moments ?or",
        "!vuelva|volver|regrese|regresar|retorne|ir|vaya !inicio|portada|principal|anterior|atrás|home ?página ?sitio ?portal",
        "!use|utilice|usar|utilizar|intente !buscador|búsqueda|búsquedas|menú|navegación ?sitio ?avanzado|avanzada ?superior ?mapa",
        "!comuníquese|contacte|póngase|contactar|llame !administrador|webmaster|soporte|mesa ?sitio ?sistema ?ayuda ?portal ?problema ?persiste ?error",
        "!consulta|búsqueda|criterio|criterios|filtro|filtros no !arrojó|arrojaron|produjo|devolvió|retornó|obtuvo|generó|coincide|coinciden resultados|resultado|registros|coincidencias|datos|documentos ?documento ?<0> ?encontraron",
        "no !encontraron|encontró|hallaron|existen|hay|obtuvieron !resultados|coincidencias|registros|documentos ?búsqueda|consulta|criterios ?<0>",
        "!verifique|revise|compruebe|corrija|confirme !parámetros|url|dirección|enlace|criterios|filtros|conexión|internet ?intente ?nuevo ?red",
        "!servicio|sitio|portal|sistema|página|plataforma|aplicativo|web !suspendido|suspendida|mantenimiento|inhabilitado|interrumpido|disponible|caído|labores ?temporalmente|momento|programado|programadas ?en ?encuentra ?disculpe ?molestias ?hoy",
        "!sitio|portal|página|servidor|plataforma|sistema !fuera !servicio|línea ?temporalmente ?encuentra ?disculpe ?molestias",
        "!mantenimiento|actualización|migración|mejoras|labores !sitio|portal|sistema|plataforma|página|programado|programadas|servidores|web ?temporal ?realizando ?encuentra ?disculpe ?molestias ?volveremos ?pronto",
        "!actualizando|mejorando|migrando|arreglando|renovando|reparando !plataforma|sitio|portal|sistema|página|servidores|servicio|experiencia|solucionarlo|problema|ello ?estamos",
        "!regresamos|volvemos|volveremos|regresaremos|estaremos|volverá|restablecerá !<0>|pronto|línea|minutos|horas|breve|mañana|tarde|noche ?servicio ?tarde ?mañana ?noche ?disponible",
        "!under|down|scheduled|temporarily maintenance|unavailable|construction|offline ?site ?this ?is ?for ?be ?back ?soon ?currently",
        "!back|online !soon|shortly|momentarily ?working ?fixing",
        "!warning|notice|deprecated|fatal|parse|strict <codigo>|error|undefined|variable|stream|<ruta>|line|connections|refused|index|failed ?to ?open ?in ?on ?<0> ?too ?many ?connection ?function ?call ?memory ?exhausted ?uncaught",
        "!error|ora|sql|sqlstate|odbc|mysql|postgres|jdbc tabla|vista|columna|esquema|base|conexión|consulta|sintaxis|cursor|tiempo|espera !existe|abrir|datos|agotado|agotada|encontrada|válida|rechazada|denegado|sintaxis|conectar|conexión ?norma|normas ?<clave> ?<0> ?<codigo> ?puede",
        "!conectar|conexión|conectarse|conectando base|datos|servidor|sql|internet !error|perdió|rechazada|agotada|fallida|falló|imposible|pudo|establecer|perdida|interrumpida",
        "!tiempo|plazo|timeout|pool|conexiones !agotado|agotada|agotadas|excedido|superado|timeout !espera|<codigo>|error|conexión|servidor|respuesta|ejecución",
        "!<codigo> ?agotado ?pool ?at ?error ?undefined ?function ?null ?exception ?not ?is ?of ?read ?property ?cannot",
        "!typeerror|referenceerror|syntaxerror|nullpointerexception|traceback|stacktrace|uncaught|undefined function|undefined|null|recent|exception|defined|token|property|error|call ?not ?is ?most ?last ?unexpected ?reference ?of ?cannot ?read",
        "!null|undefined reference|variable|function|index|property|object|pointer|exception ?not ?is ?set ?an ?instance",
        "!stack|uncaught|unhandled trace|exception|error|rejection ?promise ?in",
        "!demasiadas|demasiados|exceso|límite !solicitudes|peticiones|intentos|consultas|conexiones !red|ip|equipo|dirección|espere|minutos|superado|alcanzado|excedido|servidor ?desde ?su",
        "!tráfico|actividad|comportamiento !inusual|sospechoso|sospechosa|automatizado|automático|anormal|anómalo red|detectado|equipo|ip|dirección|sistemas ?hemos ?desde ?su",
        "!verifique|confirme|demuestre|compruebe|verificando|marque|valide|comprobando !robot|humano|humana|captcha|bot ?usted ?soy ?no ?es ?casilla",
        "!too|rate !many|limit requests|exceeded|connections ?slow",
        "!captcha|recaptcha ?robot ?i ?not ?am ?complete ?verifique",
        "!verify|checking|confirm human|browser|robot|connection|secure !human|browser|robot|secure ?you ?are ?not ?your ?before ?proceeding",
        "!solicitud|petición|dirección bloqueada|rechazada|denegada !firewall|cortafuegos|bloqueada|waf ?acceso ?fue ?por ?reglas",
    ],
    "sesion": [
        "!sesión expirado|expirada|expiró|caducado|caducada|caducó|finalizado|finalizada|finalizó|vencido|vencida|venció|terminado|terminada|terminó|cerrado|cerrada|cerró|agotado|agotada|concluido|inactividad|iniciar !expirado|expirada|expiró|caducado|caducada|caducó|finalizado|finalizada|finalizó|vencido|vencida|venció|terminado|terminada|terminó|cerrado|cerrada|cerró|agotado|agotada|inactividad|segundo|seguridad ?su ?inactividad ?tiempo ?seguridad ?actual",
        "!inicie|iniciar|inicia|reinicie|abra|reanude !sesión continuar|nuevo|nuevamente|ver|acceder|contenido|página|consultar|documento|otra ?debe ?vez ?cuenta ?usuario ?seguir",
        "!ingrese|ingresar|entre|acceda|identifíquese|autentíquese|autenticarse|loguearse|regístrese|conéctese !nuevo|nuevamente|usuario|contraseña|clave|credenciales|cuenta|continuar|portal|sistema|sesión|correo|vez ?otra ?su",
        "!acceso|enlace|token|credencial|credenciales !expirado|expiró|caducado|caducó|vencido|venció|vencidas|caducadas|inválido|inválidas|válido|incorrectas autenticarse|ingrese|nuevamente|enlace|usuario|cuenta|página|portal|sistema|acceso|solicite|token ?vuelva ?nuevo ?otro ?uno",
        "!usuario|contraseña|cuenta !contraseña|incorrecta|incorrecto|inválido|inválida|bloqueada|registrado|olvidó|recordar|recuperar|suspendida ?usuario ?clave ?olvidado",
        "!cierre|cerrar|recargue|refresque|actualice !ventana|navegador|pestaña|página ?sesión ?nuevo ?intente ?vuelva",
        "!session|login|token !expired|timed|ended|invalid|required|out|closed ?your ?has ?please ?again ?due ?inactivity",
        "!log|sign|login|signin continue|again|account|view|required|access|page ?please ?in ?you ?must ?be ?logged ?to",
    ],
    "guiones": [
        "!javascript|javascripts|scripts|script|ecmascript disabled|enable|enabled|habilite|habilitado|habilitar|active|activado|activar|actívelo|desactivado|deshabilitado|bloqueado|requiere|necesita|permitir|permita|ejecutar|ejecución|ejecute|funciona|sin|required|requires|allow|turn|needs|run|supported|apagado|encender ?navegador ?browser ?página ?sitio ?page ?site ?app ?application ?view ?continue ?visor ?portal ?norma|normas ?relatoría ?mostrar ?texto ?contenido ?visualizar ?ver ?correctamente ?content ?please ?your ?you ?need ?to ?this ?activos ?habilitados ?cookies ?on ?must ?have ?works ?aparece ?usar ?use ?para ?puede ?aplicación ?documento ?esta ?properly ?is ?it ?without ?in",
        "!cookies|cookie active|habilite|acepte|permita|enable|accept|allow|habilitar|requiere|disabled|desactivadas|bloqueadas|scripts|navegador ?scripts ?dominio ?sitio ?leer ?documento ?ver ?norma ?completa ?consultar ?providencia ?página ?please ?your ?browser ?to ?continue ?javascript ?continuar ?acceder ?contenido",
        "!turn|switch|enable on|view|run|continue|page|app|javascript !view|run|continue|page|app|javascript|reload ?it ?this",
        "!actívelo|actívelos|habilítelo|habilítelos|actívela|activarlo|habilitarlo|permítalos|desbloquéelos recargue|continuar|página|navegador|intente|seguir|nuevo ?vuelva",
        "!revise|cambie|ajuste|consulte !configuración|ajustes|opciones|preferencias !navegador|explorador|equipo|browser",
        "!navegador|explorador|browser compatible|admite|soporta|desactualizado|obsoleto|antiguo|bloquea|soportado|permite|puede|versión|incompatible|supported|outdated|actualice|viejo ?visor ?marcos ?scripts ?página ?su ?sitio ?esta ?javascript ?ejecutar ?your ?is ?reciente ?contenido ?mostrar ?no ?frames ?iframes",
        "!descargue|instale|actualice|use|utilice|cambie|pruebe|abra|change|update !navegador|explorador|browser|versión|chrome|firefox|edge|reciente ?reciente ?moderno ?compatible ?otro ?una ?actualizado",
        "!cargando|loading ?por ?favor ?espere ?momento ?contenido ?página ?datos ?documento ?please ?wait ?noscript ?un ?content ?page",
        "!espere|aguarde|wait momento|instante|segundos|favor|cargando|please|loading|cargue|mientras|segundo ?un ?por ?unos ?page ?while ?the ?loads ?página ?noscript ?contenido ?carga ?moment ?a",
        "!noscript ?cargando ?momento ?espere",
        "!vista|página|contenido|sitio|aplicación depende|requiere|necesita|usa !scripts|script|javascript ?ejecutó|ejecutados ?equipo ?navegador ?esta",
        "texto|contenido|documento|página !aparece|muestra|visualiza|ve !javascript|scripts|recargue ?active ?habilite ?navegador ?si ?no",
        "!interactiva|dinámica|dinámico|aplicación navegador|página|contenido|requiere !javascript|scripts|navegador",
    ],
}
# fixed values: words that say nothing of a window's matter and are weighed on neither side
_COMMON = """a al ante aquel aquella con de del desde e el ella en entre es esa ese eso esta está este esto están fue ha han hay la las le les lo los me mi más ni no nos o para pero por que se ser si sin sobre son su sus te tu u un una
uno usted y ya nuestro nuestra nuestros cuando como donde muy hemos ha he haya sea an and are as at be been but by can do for from has have if in is it its of on or our so that the their then there this to was we were will with you your""".split()
# fixed values: stems of the customary filler in mock Latin
_LATIN = "lorem ipsum dolor amet consect adipisc elit vestibul aliqu matti velit viverr pellentes quisque sagitt tempor tincid feugiat ornare rutrum nunc lacus magnis sodal congue fusce maecenas curabitur praesent phasell vivamus donec nulla".split()
# fixed values: words that begin like mock Latin
_SPANISH = frozenset("dolor dolores dolorosa elite temporal temporales temporada temporalmente temporalidad aliquota alícuota nulla fuscamente magnisterio".split())
# fixed values: endings that a stem has no longer, the longer first
_ENDINGS = "aciones iciones arselo ándolo ación ición adores adoras ador adora ando iendo ados adas idos idas ado ada ido ida arse erse irse ar er ir ing ed os as es ó o a e s".split()

_FIELD = re.compile(
    r"\{\{\s*[a-z]\w*(?:(?:\.|->)\w+)*\s*\}\}|\$\{\s*[\w.>-]+\s*\}|#\{\s*[\w.]+\s*\}|(?<![{$#%])\{[a-z]\w*(?:\.\w+)*\}(?!\})|<%.*?%>|\{%.*?%\}|@@\w+@@|%[A-Z][A-Z_]{2,}%|\$[a-z]\w*(?:(?:->|\.)\w+)*\$"
    r"|<<\s*[\w. ]+?\s*>>|&lt;\s*[a-z_.]+\s*&gt;|<[a-z]+[_.][a-z_.]+>|<(?!ARTICULO)[A-Z]+_[A-Z_]+>|\[(?:INSERTAR|INSERT|COMPLETAR|ESCRIBIR|INGRESE)\s[^\]\n]{1,60}\]|\[[\w.]+(?: [\w.]+){0,3} aquí\]|\[\[\s*[a-z][\w.]*\s*\]\]"
    r"|\[[a-z]+[_.][a-z_.]+\]|__[A-Z][A-Z_]{2,}__|\[object Object\]"
)
_FIELD_BEGIN = re.compile(r"[{$#<%@&\[_]")
_FIELD_WORD = re.compile(r"(?<![\w.])undefined(?! is not)(?!\w)|(?<!\w)NaN(?!\w)|(?<!\w)X{4,}(?!\w)")
_WORD = re.compile(r"<campo>|(?:[\w.$-]*[\w$]\()[\w./$:-]*\)?:?|[a-z]:?(?:/[\w.~-]+)+|(?:/[\w.~-]+){1,}|\w+(?:[.:]\w+){2,}|#?\d*\.?\w*\d\w*(?:\.\w+)*|[^\W\d_]+(?:['’-][^\W\d_]+)*")
# Codes that only machines write: calls, and dotted names that are no host and no initials.
_CODE = re.compile(r"[\w.$-]*[._$][\w.$-]*\(.*|[\w$-]{3,}\((?:\).*|[\w-]*[./$:].*)|(?!www\.)(?=(?:\w+[.:])*[^\W\d_]{3,}[.:](?:\w+[.:])*[^\W\d_]{3,})\w+(?:[.:]\w+){2,}(?<!\.\w\w)(?<!\.com|\.org|\.net|\.gov|\.edu)")
_COMMENT = re.compile(r"<!--.*?-->", re.S)
_BLANK = re.compile(r"\n[^\S\n]*\n")
_ENDS = ".!?…"
_CLOSERS = "»”\")"


def mark_fields(text: str) -> str:
    """The text with every unfilled field as one word; fields are tried only where one can begin."""
    out, at = [], 0
    for b in _FIELD_BEGIN.finditer(text):
        i = b.start()
        if i >= at and (m := _FIELD.match(text, i)):
            out += [text[at:i], " <campo> "]
            at = m.end()
    if out:
        text = "".join(out) + text[at:]
    if "undefined" in text or "NaN" in text or "XXXX" in text:
        text = _FIELD_WORD.sub(" <campo> ", text)
    return text


def stem(word: str) -> str:
    """A word without accents and, where five letters (four before a single one) are left, without its ending."""
    for e in _ENDINGS:
        if word.endswith(e) and len(word) - len(e) >= (4 if len(e) == 1 else 5):
            word = word[: -len(e)]
            break
    return "".join(c for c in unicodedata.normalize("NFD", word) if unicodedata.category(c) != "Mn")


def _norm(word: str) -> str:
    if word == "<campo>":
        return word
    if word[:1] == "/":
        return "<ruta>"
    if word.isdigit():
        return "<0>"
    if "(" in word or (("." in word or ":" in word) and len(word) > 3 and not word[0].isdigit()):
        return "<codigo>" if _CODE.fullmatch(word) else "<clave>"
    if any(c.isdigit() for c in word):
        return "<clave>" if any(c.isalpha() for c in word) and len(word) > 3 else "<0>"
    if len(word) >= 4 and word not in _SPANISH and any(word.startswith(s) for s in _LATIN):
        return "<latín>"
    return stem(word)


class _Words(dict):
    """Normalised words of a token; a cache that is begun anew when it is large."""

    def __missing__(self, token: str) -> tuple[str, ...]:
        if len(self) > 500_000:
            self.clear()
        low = token.lower()
        self[token] = value = tuple(map(_norm, (low,) if low.isalpha() else _WORD.findall(low)))
        return value


_TOKENS = _Words()
COMMON = frozenset(stem(w) for w in _COMMON)


def words(window: str) -> list[str]:
    """Words of a window; none crosses whitespace, so that a token is normalised once."""
    return [w for t in window.split() for w in _TOKENS[t]]


class Exemplar:
    """A labelled message as slots: ``must`` and ``may`` hold sets of stems, ``all`` every stem of it."""

    def __init__(self, kind: str, text: str):
        slots = [(s[0], frozenset(x if x[0] == "<" else stem(x) for x in s.lstrip("!?").split("|")) - COMMON) for s in text.split()]
        self.kind, self.text = kind, text
        self.must = [s for c, s in slots if c == "!" and s]
        self.slots = [s for c, s in slots if c != "?" and s]
        self.all = frozenset().union(*(s for _, s in slots))


def indexed(exemplars: dict[str, list[str]]) -> list[Exemplar]:
    return [Exemplar(kind, t) for kind, texts in exemplars.items() for t in texts]


#: Paragraphs of usual text that are taken to be there beside a table's own, so that a small table weighs words as a large one.
PRIOR_PARAGRAPHS = 1000
#: Words of usual legal text and the share of paragraphs that hold them, for the same purpose.
# fixed values: usual words of the domain and how many of 1,000 paragraphs hold them
_PRIOR = {
    "artículo": 291, "solicitud": 232, "archivo": 143, "prueba": 129, "título": 123, "favor": 120, "providencia": 80, "parte": 72, "recurso": 72, "oficina": 71, "consulta": 66, "petición": 63, "vigencia": 57, "todo": 51, "norma": 50, "base": 48,
    "documento": 60, "acceso": 30, "servicio": 40, "término": 60, "plazo": 60, "antes": 30, "después": 30, "nuevo": 20, "existe": 20, "sistema": 20, "sección": 20, "número": 40, "fecha": 40, "registro": 60, "falta": 40, "texto": 20, "red": 10,
}


class Model:
    """Inverse frequencies of the exemplars' stems among distinct paragraphs, and the inverted index.

    No word is left out of retrieval for being frequent; usual paragraphs are added, so that a small table weighs words
    as a large one does.
    """

    def __init__(self, paragraphs: int, frequency: dict[str, int], exemplars: dict[str, list[str]] | None = None):
        self.exemplars = indexed(exemplars or EXEMPLARS)
        vocabulary = frozenset().union(*(e.all for e in self.exemplars))
        n = max(paragraphs, 0) + PRIOR_PARAGRAPHS
        prior = {stem(w): k for w, k in _PRIOR.items()}
        self.idf = {w: math.log((n + 1) / (frequency.get(w, 0) + prior.get(w, 0) + 1)) + 0.05 for w in vocabulary}
        self.idf |= {"<0>": 0.5, "<ruta>": 1.5, "<clave>": 1.5, "<codigo>": 3.0, "<campo>": 8.0, "<latín>": 8.0, "<eco>": 8.0}
        usual = sorted(self.idf[w] for w in vocabulary)
        self.other = usual[len(usual) // 2] if usual else 1.0
        self.needs = [([s for s in e.must], [(s, max(self.idf[w] for w in s)) for s in e.slots]) for e in self.exemplars]
        self.index: dict[str, list[int]] = defaultdict(list)
        for k, e in enumerate(self.exemplars):
            # The rarest must-slot retrieves: a window that holds the exemplar holds one of its words.
            key = min(e.must or e.slots, key=lambda s: sum(math.exp(-self.idf[w]) for w in s))
            for w in key:
                self.index[w].append(k)
        self.telling = frozenset(self.index)

    def held(self, k: int, found: Collection[str]) -> bool:
        """Whether words hold all must-slots and enough of the mass of an exemplar; no word serves two must-slots."""
        must, slots = self.needs[k]
        for s in must:
            if s.isdisjoint(found):
                return False
        if len(must) > 1 and len({w for s in must for w in s if w in found}) < len(must):
            return False
        got = total = 0.0
        for s, m in slots:
            total += m
            if not s.isdisjoint(found):
                got += m
        return got >= HELD * total - 1e-9

    def retrieved(self, found: Collection[str]) -> list[int]:
        """Exemplars that words hold; none that a part of the words holds is left out."""
        near = {k for w in found if w in self.index for k in self.index[w]}
        return [k for k in near if self.held(k, found)] if near else []

    def coverage(self, window: list[str], among: Collection[int] | None = None) -> float:
        """Share of a window's mass in the exemplars of one class that it holds, ``among`` those that its paragraph retrieved."""
        tf = Counter(window)
        held = self.retrieved(tf) if among is None else [k for k in among if self.held(k, tf)]
        if not held:
            return 0.0
        weight = {w: self.idf.get(w, self.other) * (1 + math.log(n)) for w, n in tf.items() if w not in COMMON}
        mass = sum(weight.values())
        covered: dict[str, set[str]] = defaultdict(set)
        for k in held:
            covered[self.exemplars[k].kind] |= self.exemplars[k].all & tf.keys()
        return max(sum(weight[w] for w in ws) / mass for ws in covered.values())


def _echoes(found: list[str]) -> list[str]:
    """A word of two letters and more that stands three times in a row, or twice and nothing but figures with it, becomes the word of repetition.

    Fewer than three words of mock Latin are usual words.
    """
    if any(map(operator.eq, found, itertools.islice(found, 1, None))):
        least = 2 if len({w for w in found if w != "<0>"}) == 1 else 3
        out: list[str] = []
        for w, run in itertools.groupby(found):
            n = sum(1 for _ in run)
            out += ["<eco>"] if n >= least and len(w) > 1 and w[0] != "<" and w not in COMMON else [w] * n
        found = out
    if "<latín>" in found and found.count("<latín>") < 3:
        found = [w for w in found if w != "<latín>"]
    return found


def windows(paragraph: str) -> Iterator[list[str]]:
    """Passage windows of a paragraph as words: unfilled fields, lines, sentences and the whole, in parts of ``WIDTH`` that overlap by half."""
    tokens = paragraph.split()
    found = [_TOKENS[t] for t in tokens]
    spans = {(0, len(tokens))}
    start = 0
    for i, t in enumerate(tokens):
        if t[-1] in _ENDS or t[-1] in _CLOSERS and t.rstrip(_CLOSERS)[-1:] in _ENDS:
            spans.add((start, i + 1))
            start = i + 1
        if t == "<campo>":
            spans.add((i, i + 1))
    spans.add((start, len(tokens)))
    at = 0
    if "\n" in paragraph:
        for line in paragraph.split("\n"):
            n = len(line.split())
            spans.add((at, at + n))
            at += n
    for a, b in sorted(spans):
        ws = [w for t in found[a:b] for w in t]
        for i in range(0, max(len(ws) - WIDTH // 2, 1), WIDTH // 2):
            yield ws[i : i + WIDTH]


def residue(text: str | None, model: Model, coverage: float = COVERAGE) -> list[tuple[int, str, float]]:
    """``(paragraph number, paragraph, coverage)`` of the residue paragraphs of a text."""
    if not text:
        return []
    marked = mark_fields(_COMMENT.sub("", text) if "<!--" in text else text)
    out = []
    k = 0
    for raw in _BLANK.split(marked):
        p = raw.strip()
        if not p:
            continue
        k += 1
        found = frozenset(_echoes(words(p)))
        if model.telling.isdisjoint(found) or not (among := model.retrieved(found)):
            continue
        best = max((model.coverage(_echoes(w), among) for w in windows(p)), default=0.0)
        if best >= coverage:
            out.append((k, p, best))
    return out


def signs(text: str | None, sign: dict[str, str]) -> Iterator[tuple[int, str]]:
    """``(id, exemplars' stems as one character each)`` of the paragraphs of a text; figures, codes and paths are not in the id."""
    for p in _BLANK.split(text) if text else ():
        if found := {w for t in p.split() for w in _TOKENS[t]}:
            yield xxhash.xxh64_intdigest(" ".join(filter(str.isalpha, p.lower().split()))) - 2**63, "".join(sign[w] for w in found & sign.keys())


def train(rows: DataFrame, exemplars: dict[str, list[str]] | None = None) -> Model:
    """Frequencies over the distinct paragraphs of all rows of ``(markdown)``, so that residue, however often, counts once.

    A partition sends each of its distinct paragraphs once, as an id and the exemplars' stems in it; one row for each of
    these stems reaches the driver.
    """
    order = sorted(frozenset().union(*(e.all for e in indexed(exemplars or EXEMPLARS))))
    sign = {w: chr(0x100 + k) for k, w in enumerate(order)}

    def distinct(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[int] = set()
        for batch in batches:
            new = {h: w for text in batch["markdown"] for h, w in signs(text, sign) if h not in seen}
            seen.update(new)
            yield pd.DataFrame({"h": pd.Series(list(new), dtype="int64"), "w": list(new.values())})

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[int] = set()
        counts: Counter = Counter()
        for batch in batches:
            for h, w in zip(batch["h"], batch["w"]):
                if h not in seen:
                    seen.add(h)
                    counts.update(w)
                    counts[""] += 1
        yield pd.DataFrame(list(counts.items()), columns=["w", "n"])

    once = rows.select("markdown").mapInPandas(distinct, "h bigint, w string").repartition("h")
    counts = {r.w: r.n for r in once.mapInPandas(count, "w string, n bigint").groupBy("w").agg(F.sum("n").alias("n")).collect()}
    return Model(counts.get("", 0), {w: counts.get(sign[w], 0) for w in order}, exemplars)


def found(rows: DataFrame, model: Model | None = None, coverage: float = COVERAGE, exemplars: dict[str, list[str]] | None = None) -> DataFrame:
    """``(texto_id, parrafo, texto, cobertura)``: the residue paragraphs of ``(texto_id, markdown)``.

    Null and empty texts have none; repeated rows give repeated results; an empty table gives none. Texts are read
    whole; the statistics are those of the distinct paragraphs of all rows. ``exemplars`` replaces the labelled ones.
    """
    rows = rows.select("texto_id", "markdown")
    if model is None:
        model = train(rows, exemplars)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [(i, *r) for i, t in zip(batch["texto_id"], batch["markdown"]) for r in residue(t, model, coverage)]
            yield pd.DataFrame(out, columns=["texto_id", "parrafo", "texto", "cobertura"]).astype({"cobertura": np.float64})

    return rows.mapInPandas(run, "texto_id bigint, parrafo int, texto string, cobertura double")
