import pytest

from tamiz.llm import residue as R


@pytest.fixture(scope="module")
def model():
    return R.Model(1000, {})


@pytest.mark.parametrize("text", [
    "{{ organo }}", "La Ley ${numero} de <%= anio %> fue expedida por @@ORGANO@@.", "[INSERTAR NOMBRE ENTIDAD]", "undefined", "NaN.", "[object Object]", "Emitido por: __TITULO__", "Lorem ipsum dolor sit amet, consectetur adipiscing elit.",
    "Access Denied\n\nYou don't have permission to access /base/ley_1.html. Reference #35.3k3wtx", "404 Not Found", "# Error 503", "Su sesión ha expirado. Inicie sesión para continuar.", "Cargando… Si el texto no aparece, active JavaScript",
    "Please enable JavaScript to continue.", "Warning: include(/srv/norma.inc): Too many connections in /srv/www/ver.php on line 12", "Test test test test 8", "Aquí va el texto de la parte resolutiva", "ARTÍCULO 1. El juez decidirá.\n\n¡Ups! Algo salió mal al cargar esta norma. Vuelva al inicio.\n\nARTÍCULO 2. Fin.",
])
def test_residue(model, text):
    assert R.residue(text, model)


@pytest.mark.parametrize("text", [
    "ARTÍCULO 1. El juez decidirá el recurso.", "{{Inciso modificado por el artículo 5 de la Ley 7 de 1990}}", "<Aparte subrayado condicionalmente exequible> El juez decidirá.", "El formato se diligenciará así: nombre ____________, documento ______",
    "Los portales de las entidades funcionarán aunque el usuario tenga desactivado JavaScript, y el importador liquidará las cuotas.", "El error 404 del protocolo de intercambio se registrará en la bitácora y el curador decidirá.",
    "Si la sesión del usuario expira, el operador le permitirá recuperarla; la sala decidirá.", "El notario verificará que no queden espacios en blanco ni textos de relleno, y el empleador firmará.", "<!-- pagina 1 -->\nPágina 12\nEl juez decidirá [...] lo pedido.", "TODO CASO SERÁ RESUELTO", "", None,
])
def test_real_content(model, text):
    assert not R.residue(text, model)


def test_paragraph_numbers(model):
    assert [(k, p) for k, p, _ in R.residue("Uno.\n\n\nDos.\n\n404 Not Found", model)] == [(3, "404 Not Found")]


def test_table(spark):
    rows = [(k, "El juez decidirá el recurso de la parte.") for k in range(30)] + [(50, "El juez.\n\n{{organo}}"), (51, None), (52, ""), (53, "x " * 100_000 + "\n\nAccess Denied"), (50, "El juez.\n\n{{organo}}")]
    df = spark.createDataFrame(rows, "texto_id bigint, markdown string").selectExpr("*", "1 as w", "2 as texto")
    assert sorted((r.texto_id, r.parrafo) for r in R.found(df).collect()) == [(50, 2), (50, 2), (53, 2)]
    assert R.found(df.where("false")).count() == 0


FILLED = {"<0>": "12", "<ruta>": "/srv/x/ley.html", "<codigo>": "mysql_connect():", "<clave>": "a3f9x", "<campo>": "{{organo}}", "<latín>": "lorem ipsum amet", "<eco>": "bla bla bla"}


@pytest.mark.parametrize("exemplar", [x for texts in R.EXEMPLARS.values() for x in texts])
def test_every_exemplar_alone(model, exemplar):
    """The first words of an exemplar's slots, those of its must-slots all different, are residue by themselves."""
    used, text = set(), []
    for slot in exemplar.split():
        if slot[0] != "?":
            word = next((w for w in slot.lstrip("!").split("|") if R.stem(w) not in used), "")
            used.add(R.stem(word))
            text.append(FILLED.get(word, word))
    text = " ".join(text)
    assert R.residue(text, model) and R.residue("El juez decidirá.\n\n" + text.capitalize(), model)


#: Wordings that no exemplar was written for.
UNSEEN = """Nuestro portal se encuentra en labores de mantenimiento. Disculpe las molestias.
Estamos realizando mantenimiento programado en nuestros servidores.
Algo se rompió de nuestro lado. Ya lo estamos arreglando.
Something broke on our end. We are working to fix it.
Oops! Something went wrong. Please try again.
Para visualizar esta página debe permitir la ejecución de scripts.
Necesita habilitar JavaScript para usar esta aplicación.
Esta aplicación web requiere JavaScript.
Contenido provisional: será reemplazado por el texto definitivo.
Este texto es provisional y se cambiará antes de la publicación.
Su acceso ha vencido. Vuelva a autenticarse.
El enlace ha expirado, solicite uno nuevo.
Your session has timed out. Please sign in again.
Su sesión se cerró por seguridad tras un periodo de inactividad.
La página que intenta ver no existe o fue eliminada.
Lo sentimos, el documento solicitado no se encuentra disponible.
No se encontraron resultados para su búsqueda.
HTTP Error 500 - Internal server error
502 Bad Gateway nginx
You are not authorized to view this page.
No tiene permisos suficientes para acceder a este recurso.
Se produjo un error inesperado al procesar su solicitud.
Error al conectar con la base de datos
Fatal error: Uncaught Exception in /var/www/index.php on line 20
This site is under construction.
Página en construcción
Inserte aquí el título del documento
[Escriba aquí su texto]
Sample paragraph. Replace this text before publishing.
Your title goes here
Too many requests, please slow down.
Complete the captcha to verify you are human.
Demuestre que no es un robot
Su navegador no soporta esta versión del sitio. Actualice su navegador.
Por favor espere mientras carga la página
Checking your browser before proceeding
The page you are looking for could not be found.
Servicio temporalmente no disponible
El sistema está fuera de servicio. Intente nuevamente en unos minutos.
This page requires JavaScript. Please turn it on in your browser settings.
Hola hola hola hola
Usuario o contraseña incorrecta
Debe iniciar sesión para consultar el documento.
No fue posible cargar el contenido solicitado.
Estamos haciendo mejoras en el sistema. Volvemos en breve.
Disculpe, ocurrió un problema técnico al abrir el documento.
The server is temporarily unable to handle your request: 503 Service Unavailable
The document you requested has been removed.
El vínculo está roto o el contenido fue trasladado a otra dirección.
Ha superado el límite de consultas. Espere unos minutos.
Autentíquese con sus credenciales para continuar.
Login required. Please log in to view this content.
La búsqueda no devolvió registros.
Habilite las cookies de su navegador para continuar.
This content cannot be displayed because scripts are blocked in your browser.
Párrafo de ejemplo que será sustituido por la oficina.
Pendiente de redacción
Su token de acceso ha caducado.
We'll be back soon!
Tiempo de espera agotado al conectar con el servidor
Unexpected error occurred. Contact the administrator.
Aún no hay contenido: texto de muestra.""".split("\n")


def test_unseen_wordings(model):
    missed = [t for t in UNSEEN if not R.residue(t, model)]
    assert len(missed) <= 0.1 * len(UNSEEN), missed


@pytest.mark.parametrize("text", """La firma
El resumen
Los considerandos
La parte resolutiva
El anexo técnico
La nota de vigencia
PRUEBAS
CAPÍTULO I PRUEBAS
El error en la notificación no invalida la actuación.
La sesión de la asamblea terminó a las cinco de la tarde.
La sesión podrá ser cerrada por el presidente.
El recurso no existe cuando la parte no lo presenta en el término.
El servidor público que no pudo atender la solicitud responderá en el término de ley.
El acceso al archivo será restringido a las partes.
La página del expediente será foliada y firmada.
Los usuarios del servicio deberán iniciar el trámite ante la oficina.
Intentada la notificación, vuelva el expediente al despacho.
El plazo se entenderá agotado cuando se notifique.
Queda prohibido el acceso de personas no autorizadas.
El documento se encuentra en revisión del comité técnico.
El error de hecho vicia el consentimiento.
La consulta no obliga a la entidad.
Falta de competencia
Pendiente el pago, no se registrará el título.
El sistema estará en mantenimiento durante la noche y el operador informará a los usuarios con antelación, según lo ordene la junta.
La parte que no inicie sesión en el registro dentro del plazo perderá el turno que le corresponda en el reparto.
No hubo acuerdo
El texto definitivo será publicado en la gaceta.
Sesión ordinaria
Prueba documental
TODO CASO SERÁ RESUELTO""".split("\n"))
def test_headings_and_words_of_residue_in_real_text(model, text):
    assert not R.residue(text, model)


@pytest.mark.parametrize("text", ["java.lang.NullPointerException", "mysql_connect():", "include(/srv/norma.inc)", "Nunc lacus magnis sodales congue fusce"])
def test_codes_and_mock_latin_alone(model, text):
    assert R.residue(text, model)


@pytest.mark.parametrize("text", ["ARTÍCULO 12Bis", "Artícul0 7", "Se protocoli2ará.", "Aguas S.A.S.", "www.gaceta.gov.co", "portal.gaceta.gov.co", "Señor(a)", "12/03/2010"])
def test_figures_and_points_of_real_words(model, text):
    assert not R.residue(text, model)


def test_frequent_residue(spark):
    page = "La página solicitada no existe. Vuelva al inicio."
    rows = [(k, f"El juez decidirá el recurso {k} de la parte.") for k in range(40)] + [(100 + k, page) for k in range(20)]
    df = spark.createDataFrame(rows, "texto_id bigint, markdown string")
    assert sorted(r.texto_id for r in R.found(df).collect()) == list(range(100, 120))


@pytest.mark.parametrize("text", ["Su sesión ha expirado.", "Error 503", "Xxx xxx xxx", "Prueba prueba prueba 6", "La página solicitada no existe"])
def test_one_row(spark, text):
    rows = spark.createDataFrame([(1, text)], "texto_id bigint, markdown string")
    assert [r.texto_id for r in R.found(rows).collect()] == [1]


@pytest.mark.parametrize("text", ["El juez decidirá el recurso de la parte.", "Prueba", "A falta\nde norma.", "TÍTULO I", "Artículo 5. El título de la solicitud se archivará."])
def test_one_row_of_real_content(spark, text):
    rows = spark.createDataFrame([(1, text)], "texto_id bigint, markdown string")
    assert R.found(rows).count() == 0


@pytest.mark.parametrize("text", ["bla " * 100, "xxx " * 61, "su sesión ha expirado inicie sesión para continuar " * 12, "El juez decidirá el recurso de la parte y " * 9 + "javascript is disabled in your browser turn it on to view this page " * 7])
def test_long_sentences_without_marks(model, text):
    assert R.residue(text, model)


def test_long_real_sentence(model):
    assert not R.residue("El juez decidirá el recurso de la parte y el operador verificará la sesión del usuario en la norma, " * 12, model)
