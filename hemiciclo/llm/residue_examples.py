"""Written examples of residue and of what merely looks like it, made by small grammars.

None is taken from a table: the wording is what sites, programs, page builders and template
languages commonly show, in Spanish, Portuguese and English. A grammar is a frame with slots;
a kind is a family of frames, so that tests can leave a kind out.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator

# Reason phrases of HTTP (RFC 9110).
REASONS = {400: "bad request", 401: "unauthorized", 402: "payment required", 403: "forbidden", 404: "not found", 405: "method not allowed", 408: "request timeout", 409: "conflict", 410: "gone", 413: "content too large", 429: "too many requests", 500: "internal server error", 501: "not implemented", 502: "bad gateway", 503: "service unavailable", 504: "gateway timeout", 505: "http version not supported"}
# Fixed value: the usual filler Latin, after Cicero.
LATIN = "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua ut enim ad minim veniam quis nostrud exercitation ullamco laboris nisi ut aliquip ex ea commodo consequat duis aute irure dolor in reprehenderit in voluptate velit esse cillum dolore eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt in culpa qui officia deserunt mollit anim id est laborum curabitur pretium tincidunt lacus nulla gravida orci a odio nullam varius turpis et commodo pharetra est eros bibendum elit nec luctus magna felis sollicitudin mauris integer in mauris eu nibh euismod gravida duis ac tellus et risus vulputate vehicula donec lobortis risus a elit etiam tempor ut ullamcorper ligula eu tempor congue eros est euismod turpis id tincidunt sapien risus a quam maecenas fermentum consequat mi donec fermentum pellentesque malesuada nulla a mi duis sapien sem aliquet nec commodo eget consequat quis neque aliquam faucibus elit ut dictum aliquet felis nisl adipiscing sapien sed malesuada diam lacus eget erat cras mollis scelerisque nunc nullam arcu aliquam consequat curabitur augue lorem dapibus quis laoreet et pretium ac nisi aenean magna nisl mollis quis molestie eu feugiat in orci in hac habitasse platea dictumst praesent vestibulum morbi ornare rutrum vivamus suscipit porta".split()
ROWS = ["qwertyuiop", "asdfghjklñ", "zxcvbnm"]

SLOT_WORDS = "nombre apellido fecha monto plazo cargo título tema lugar región distrito autor correo teléfono dirección entidad meta año número texto valor moneda responsable resumen descripción name surname date amount title place address email phone value subject company city country nome sobrenome data valor cidade assunto empresa endereço".split()

SLOTS = {
    "thing": "la página|el sitio|el sitio web|el recurso solicitado|el documento|el archivo|el enlace|la dirección|el contenido|esta url|la ruta|la aplicación|el portal|la imagen|el registro",
    "gone": "no existe|no fue hallada|no se encontró|no ha sido encontrado|ya no está disponible|fue eliminado|se ha movido|cambió de lugar|no se puede mostrar|no pudo abrirse|no se pudo cargar|dejó de existir|no está en este servidor",
    "machine": "el servidor|nuestro servidor|el servicio|el sistema|la base de datos|la conexión|la plataforma|la red|el servidor web|el proveedor",
    "broke": "no responde|no está disponible por el momento|está fuera de servicio|se encuentra en mantenimiento|tardó demasiado en responder|devolvió un error|ha fallado|ha sufrido un error inesperado|se interrumpió|no aceptó la conexión|está sobrecargado|rechazó la petición|encontró un problema",
    "done": "su sesión|la sesión|su solicitud|la petición|la consulta|su usuario|su contraseña|el formulario|el token|el certificado",
    "ended": "ha caducado|ha vencido|ha terminado|fue rechazada|no pudo procesarse|no es válida|no pudo completarse|no ha sido autorizada|se cerró por inactividad|contiene errores",
    "retry": "intente otra vez más tarde|vuelva a intentarlo en unos minutos|inténtelo de nuevo|recargue la página|actualice la ventana|compruebe la dirección escrita|revise su conexión a internet|póngase en contacto con el administrador|avise al soporte técnico|ingrese de nuevo|inicie sesión otra vez|vuelva a la página anterior|regrese a la portada|ir al inicio|disculpe las molestias|lamentamos los inconvenientes|gracias por su paciencia",
    "cosa": "a página|o site|o recurso solicitado|o documento|o arquivo|o link|o endereço|o conteúdo|este portal|a imagem",
    "sumiu": "não existe|não foi localizada|não pôde ser exibida|não está mais disponível|foi removido|mudou de lugar|não pôde ser carregado|não está neste servidor",
    "maquina": "o servidor|o serviço|o sistema|o banco de dados|a conexão|a rede|a plataforma",
    "caiu": "não responde|está fora do ar|está em manutenção|demorou para responder|retornou um erro|falhou|está temporariamente indisponível|encontrou um erro inesperado|recusou a conexão",
    "tente": "tente outra vez mais tarde|tente novamente em alguns minutos|recarregue a página|verifique o endereço digitado|fale com o administrador|entre em contato com o suporte|entre novamente|volte à página anterior|pedimos desculpas pelo transtorno",
    "item": "the page|this page|the site|the requested resource|the document|the file|the link|the address|this content|the image|the record|the object",
    "lost": "does not exist|could not be found|is no longer available|has been removed|has moved|cannot be displayed|could not be loaded|could not be opened|is not on this server|is missing",
    "host": "the server|our server|the service|the system|the database|the connection|the network|the web server|the upstream host|the application",
    "down": "is not responding|is temporarily unavailable|is down for maintenance|timed out|took too long to respond|returned an error|has failed|ran into an unexpected problem|refused the connection|is overloaded|was unable to complete your request|encountered an error",
    "again": "try again later|please try again in a few minutes|reload the page|refresh the window|check the address|check your internet connection|contact the administrator|contact support|sign in again|go back to the previous page|return to the home page|we apologize for the inconvenience|sorry for the trouble|thank you for your patience",
    "oops": "lo sentimos|ups|perdón|atención|aviso|error|error del sistema|oops|sorry|we are sorry|something went wrong|algo salió mal|ha ocurrido un error|se ha producido un error|ocurrió un fallo|an error occurred|an error has occurred|desculpe|ops|algo deu errado|ocorreu um erro|erro",
    "turn": "active|habilite|permita|encienda|autorice|debe activar|tiene que habilitar|es necesario activar|necesita habilitar|por favor, active|por favor, permita",
    "tech": "javascript|js|las cookies|los scripts|javascript y las cookies|la ejecución de scripts|las ventanas emergentes",
    "why": "para continuar|para ver el sitio|para ver esta página|para usar la aplicación|para seguir navegando|en su navegador|en las opciones de su navegador|y vuelva a cargar la página|para acceder al contenido|para que el sitio funcione",
    "ligue": "ative|habilite|permita|você precisa ativar|é necessário habilitar|por favor, ative",
    "tec": "o javascript|os cookies|os scripts|o js|javascript e cookies",
    "pq": "para prosseguir|para ver o site|para usar o aplicativo|no seu navegador|e recarregue a página|para acessar o conteúdo",
    "enable": "enable|turn on|allow|please enable|please turn on|please allow|you must enable|you have to turn on",
    "js": "javascript|js|cookies|scripts|javascript and cookies|scripting|pop-ups",
    "for": "to continue|to use this site|to see the content|to run the application|in your browser|in your browser settings|and refresh the page|to access this page|for the site to work",
    "browser": "su navegador|este navegador|la versión de su navegador",
    "unfit": "no es compatible|está desactualizado|no admite javascript|no acepta cookies|tiene javascript desactivado|bloquea los scripts|no puede ejecutar esta aplicación",
    "adds": "write|type|insert|add|place|put|enter|paste|replace",
    "yours": "your text|your title|your content|some text|the description|a caption|your heading|a subtitle|the body text",
    "escriba": "escriba|ingrese|inserte|agregue|añada|coloque|pegue|reemplace|digite|edite",
    "esto": "su texto|el texto|un título|el título|la descripción|su contenido|el contenido|una imagen|el subtítulo|este párrafo|un resumen|el cuerpo del mensaje",
    "aqui": "aquí|en este espacio|en esta casilla|en este recuadro|en este bloque",
    "insira": "insira|digite|escreva|adicione|cole|substitua",
    "isso": "seu texto|o texto|um título|o título|a descrição|o conteúdo|a imagem|este parágrafo",
    "draft": "de prueba|de muestra|de relleno|temporal|ficticio|de demostración|por reemplazar|sin redactar",
    "piece": "texto|contenido|párrafo|título|bloque|documento|mensaje|resumen|artículo",
    "pending": "por completar|por definir|pendiente|sin completar|en elaboración|en preparación|por redactar|en construcción|próximamente|por confirmar",
    "rascunho": "de teste|provisório|temporário|fictício|de demonstração|em construção|em breve|a definir|a preencher|sem redação",
    "peca": "texto|conteúdo|parágrafo|título|bloco|documento|seção",
    "dummy": "sample|dummy|placeholder|example|test|temporary|demo|filler",
    "bit": "text|content|paragraph|heading|copy|page|section|document",
    "soon": "under construction|to be defined|to be completed|to be announced|work in progress|draft only|not for publication|do not publish|more information soon",
    "fn": "main|render|load|index|get_user|save|connect|handle|process|init|parse|send|open|query",
    "file": "app|main|index|server|views|utils|config|database|loader|handler|functions|plan|page",
    "cls": "NullPointerException|IllegalStateException|RuntimeException|IOException|ValueError|TypeError|KeyError|IndexError|AttributeError|SyntaxError|ReferenceError|ImportError|ZeroDivisionError|OutOfMemoryError|TimeoutException|SQLException|FileNotFoundException|UnicodeDecodeError",
    "var": "user|data|id|result|name|value|item|row|page|session|token|title",
    "n": "#",
    "hex": "@",
}

# kind -> frames; {x} is a slot
NOTICES = {
    "missing": ["{thing} {gone}", "{oops}: {thing} {gone}", "{thing} que busca {gone}. {retry}", "{thing} {gone}. {retry}", "no se encontró {thing}", "no pudimos encontrar {thing}", "no hay resultados para mostrar", "página no disponible", "archivo no encontrado", "contenido no disponible", "{cosa} {sumiu}", "{cosa} que você procura {sumiu}. {tente}", "{oops}: {cosa} {sumiu}", "não encontramos {cosa}", "conteúdo indisponível", "arquivo não localizado", "{item} {lost}", "{item} you are looking for {lost}. {again}", "{oops}! {item} {lost}", "we could not find {item}", "page not available", "no results to display", "file not found"],
    "status": ["{status}", "error {status}", "http {status}", "http/1.1 {status}", "{code} error", "error {code}", "código de error: {code}", "código de error {hex}", "error code: {code}", "código do erro: {code}", "status {code}", "estado {code}", "error número {code}. {retry}", "{status} nginx", "apache server at port {code}", "ray id: {hex}", "id de la solicitud: {hex}", "número de incidente {hex}", "request id {hex}", "referencia del error: {hex}", "error reference {hex}", "trace id {hex}"],
    "outage": ["{machine} {broke}", "{machine} {broke}. {retry}", "{oops}: {machine} {broke}", "no se pudo conectar con {machine}", "no fue posible conectarse a {machine}", "falló la conexión con {machine}", "estamos realizando tareas de mantenimiento", "sitio en mantenimiento", "error interno", "error interno del sistema", "error de conexión", "error de la aplicación", "{maquina} {caiu}", "{maquina} {caiu}. {tente}", "não foi possível conectar com {maquina}", "site em manutenção", "erro interno do sistema", "erro de conexão", "{host} {down}", "{host} {down}. {again}", "could not connect to {host}", "unable to reach {host}", "connection to {host} failed", "internal error", "we are performing scheduled maintenance", "site under maintenance", "application error", "gateway error", "connection lost", "connection reset by peer", "this site can't be reached"],
    "access": ["{done} {ended}", "{done} {ended}. {retry}", "acceso restringido", "acceso no autorizado", "no tiene permisos para ver {thing}", "usted no está autorizado a ver {thing}", "permiso denegado", "debe iniciar sesión para continuar", "inicie sesión para ver {thing}", "demasiados intentos. {retry}", "ha superado el límite de consultas", "usuario o contraseña incorrectos", "acesso restrito", "acesso não autorizado", "você não tem permissão para acessar {cosa}", "sessão encerrada. {tente}", "sua sessão terminou por inatividade", "muitas tentativas. {tente}", "faça login para continuar", "unauthorized access", "permission denied", "you are not authorized to view {item}", "you need permission to access {item}", "your session has timed out", "session closed", "sign in to continue", "too many attempts. {again}", "rate limit exceeded", "invalid username or password", "this request was blocked", "your ip address has been blocked"],
    "program": ['file "{file}.py", line {n}, in {fn}', "{cls}: {var}", "{cls}: '{var}'", "java.lang.{cls}", "exception in thread \"{fn}\" java.lang.{cls}", "at {file}.{fn}({file}.java:{n})", "at {fn} ({file}.js:{n}:{n})", "uncaught {cls}: {var} is not defined", "uncaught {cls}: cannot read properties of undefined (reading '{var}')", "{cls}: '{var}' object has no attribute '{fn}'", "{cls}: unsupported operand type(s)", "unhandled exception: {cls}", "caused by: {cls}", "php notice: undefined variable: {var} in /var/www/{file}.php on line {n}", "warning: require({file}.php): failed to open stream: no such file or directory in /var/www/html/{file}.php on line {n}", "warning: fopen({file}.txt) [function.fopen]: failed to open stream: permission denied in {file}.php on line {n}", "parse error: unexpected end of file in {file}.php on line {n}", "fatal error: call to undefined function {fn}() in {file}.php:{n}", "fatal error: maximum execution time exceeded on line {n}", "sqlstate[{n}]: table '{var}' not found", "sql error: syntax error near '{var}'", "ora-{n}: table or view does not exist", "mysql server has gone away", "stack trace: #{n} {file}.php({n}): {fn}()", "memory access violation at address 0x{hex}", "core dumped", "bus error", "null reference at {file}.{fn}", "error: cannot find module '{file}'", "command not found: {fn}", "error in {file}.{fn} line {n}", "no such file or directory: {file}.txt", "warning: division by zero in {file} on line {n}", "panic: runtime error: index out of range", "assertion failed: {file}.c, line {n}"],
    "scripts": ["{turn} {tech} {why}", "{turn} {tech}", "{turn} {tech} {why}. {retry}", "esta página necesita {tech}", "este sitio necesita {tech} {why}", "esta aplicación requiere {tech}", "el sitio no funciona sin {tech}", "{browser} {unfit}", "{browser} {unfit}. {turn} {tech}", "desactive el bloqueador de anuncios {why}", "use otro navegador", "sin {tech} no se puede mostrar el contenido", "javascript está desactivado", "{ligue} {tec} {pq}", "{ligue} {tec}", "este site precisa de javascript", "este aplicativo não funciona sem javascript", "seu navegador não aceita cookies", "seu navegador bloqueia os scripts", "{enable} {js} {for}", "{enable} {js}", "this page needs {js}", "this site requires {js} {for}", "this application does not work without {js}", "your browser does not support {js}", "your browser is out of date", "{js} is disabled in your browser", "{js} must be enabled {for}", "disable your ad blocker {for}", "without {js} this page cannot be shown"],
    "checks": ["confirme que es una persona", "confirme que usted no es un robot", "demuestre que no es un robot", "resuelva el captcha {why}", "escriba los caracteres de la imagen", "marque la casilla para demostrar que es humano", "estamos verificando su navegador", "verificando que la conexión sea segura", "comprobación de seguridad en curso", "un momento", "espere un momento, por favor", "cargando el contenido", "redirigiendo", "acepte las cookies {why}", "confirme que você é humano", "resolva o captcha {pq}", "verificando o seu navegador", "aguarde um momento, por favor", "carregando", "aceite os cookies {pq}", "confirm that you are a human", "prove you are not a robot", "solve the captcha {for}", "complete the security check {for}", "checking if the connection is secure", "verifying your browser", "please wait a moment", "loading", "loading content", "redirecting", "accept cookies {for}", "one more step before you proceed"],
}
FILLER = {
    "latin": ["{latin}"],
    "keys": ["{keys}"],
    "prompt": ["{escriba} {esto} {aqui}", "{escriba} {aqui} {esto}", "haga clic {aqui} para editar {esto}", "pulse para agregar {esto}", "toque para editar {esto}", "doble clic para cambiar {esto}", "{esto} {aqui}", "aquí irá {esto}", "en este bloque se mostrará {esto}", "{insira} {isso} aqui", "clique para editar {isso}", "aqui entra {isso}", "{adds} {yours} here", "click to edit {yours}", "tap to add {yours}", "{yours} goes in this box", "{yours} here", "double click to change {yours}"],
    "replace": ["este {piece} debe ser sustituido por el definitivo", "este {piece} será reemplazado", "este {piece} debe reemplazarse antes de publicar", "sustituya este {piece} por el suyo", "reemplace el {piece} de este campo", "campo de texto", "campo vacío", "campo obligatorio", "este campo debe completarse", "aquí debe ir el {piece} final", "falta el {piece} definitivo", "este {peca} deve ser substituído", "substitua este {peca} pelo seu", "campo de texto vazio", "este campo deve ser preenchido", "falta o {peca} final", "this {bit} will be replaced", "this {bit} must be replaced with the final version", "replace this {bit} with your own", "empty text field", "required field", "this field must be completed", "final {bit} goes here"],
    "draft": ["{piece} {draft}", "este es un {piece} {draft}", "{piece} {draft}, no difundir", "{piece} {pending}", "({pending})", "({piece} {pending})", "{pending}", "esta sección está {pending}", "sección {pending}", "item uno. item dos. item tres", "ítem {n}", "elemento de lista {n}", "opción {n}", "sin título", "sin contenido", "borrador, no distribuir", "versión de prueba", "{peca} {rascunho}", "este é um {peca} {rascunho}", "({rascunho})", "sem título", "rascunho, não divulgar", "item da lista {n}", "{dummy} {bit}", "this is {dummy} {bit}", "this is just {dummy} {bit}", "{dummy} {bit} for layout purposes", "{soon}", "({soon})", "this {bit} is {soon}", "list item {n}", "untitled", "untitled document", "title goes here"],
}
# shapes of unfilled slots: template languages, mail merges, word processors, format strings, forms
BRACKETS = ["{{%s}}", "{{ %s }}", "{{{%s}}}", "${%s}", "$%s$", "#{%s}", "[[%s]]", "[%%%s%%]", "%%%s%%", "%%(%s)s", "<%%= %s %%>", "{%% %s %%}", "<<%s>>", "<?%s?>", "@@%s@@", "##%s##", "#%s#", "__%s__", "{%s}", "~~%s~~", "[*%s*]", "<!-- %s -->", "&lt;%s&gt;", "__[%s]__", "@{%s}", "$(%s)", "||%s||", "***%s***"]
ASKING = ["[%s]", "(%s)", "<%s>", "{%s}", "«%s»", "...(%s)...", "…%s…", "-- %s --", "*%s*", "/* %s */"]
ASKS = ["insertar %s", "inserte %s", "completar %s", "complete %s", "escriba %s", "escriba aquí %s", "colocar %s", "agregar %s", "indicar %s", "indique %s", "%s aquí", "%s pendiente", "%s por definir", "falta %s", "poner %s", "llenar %s", "rellenar %s", "su %s", "nombre de %s", "todo: %s", "todo %s", "insert %s", "insert %s here", "enter %s", "your %s", "add %s", "%s here", "%s tbd", "fill in %s", "type %s", "replace with %s", "inserir %s", "preencher %s", "seu %s", "%s aqui", "a definir: %s"]
MARKS = ["undefined", "nan", "null", "tbd", "tba", "xxx", "xxxx", "xx/xx/xxxx", "dd/mm/yyyy", "dd/mm/aaaa", "mm/yyyy", "yyyy-mm-dd", "[object object]", "#value!", "#ref!", "#n/a", "#div/0!", "#name?", "#num!", "#null!", "#¡valor!", "#¡ref!", "#n/d", "#¡div/0!", "#¿nombre?", "#¡num!", "%s", "%d", "{0}", "{1}", "{}", "$1", "x,xx", "xx%", "s/ xx", "$ xx.xx", "____", "________", "......... (firma)", "function () { [native code] }", "lorem", "n.º xx", "no. xxx"]
# what looks like residue and is none
NATURAL = ["[%d]", "[%d, %d]", "(%d)", "(véase el anexo %d)", "(ver página %d)", "«%w»", "«%w %w %w»", '"%w %w"', "(%w)", "(%w %w %w)", "(%A)", "%w (%A)", "%w_%d", "%w_%w_%d", "%w_%d %w %w_%w_%d", "%w_%w %w %w_%w", '{"%w": %d, "%w": "%w"}', "https://www.%w.%w/%w?id=%d", "%w@%w.%w", "@%w", "#%w", "%d %%", "%d%%", "S/ %d millones", "US$ %d", "%d/%d/%d", "a) %w", "%d) %w", "<3", "x < y", "a > b", "%d <= %d", ":-)", "========", "--------", "********", "• %w", "%w/%w", "%w - %w", "n.º %d", "art. %d", "%w: %w", "[...]", "(...)", "[sic]", "¿%w %w?", "¡%w %w!", "%d x %d", "%d + %d = %d", "<|%w|>", "<|%w_%w|>", "<%w>%w</%w>", "$%d", "#%d", "& %w", "*%w*", "%w | %w | %w", "\t%d\t%d", "~%d", "^_^", "©®™ %w", "½ ¾ ±%d"]


def made_word(r: random.Random) -> str:
    return "".join(r.choices(["ta", "pre", "su", "mu", "ni", "ci", "pio", "ob", "je", "ti", "vo", "na", "dor", "ra", "con", "lis", "men", "to", "al", "es"], k=r.randrange(2, 5)))


def filled(frame: str, r: random.Random, depth: int = 0) -> str:
    """A frame with each slot filled at random; numbers and codes are made."""

    def one(m: re.Match) -> str:
        name = m[1]
        if name == "latin":
            start, size = r.randrange(len(LATIN)), r.randrange(4, 30)
            words = LATIN[start : start + size] if r.random() < 0.6 else r.choices(LATIN, k=size)
            return " ".join(words)
        if name == "keys":
            row = r.choice(ROWS)
            start = r.choice([0, 0, r.randrange(max(1, len(row) - 4))])
            mash = row[start : start + r.randrange(3, 7)]
            word = r.choice([mash, mash, mash + mash, r.choice("axzbl") * r.randrange(3, 6), "test", "testing", "prueba", "teste", "foo", "bar", "baz", "bla", "blah", "abc"])
            return word if depth > 8 or r.random() < 0.15 else word + " " + filled("{keys}", r, depth + 1)
        if name == "code":
            return str(r.choice(list(REASONS)))
        if name == "status":
            code = r.choice(list(REASONS))
            return f"{code} {REASONS[code]}"
        choice = r.choice(SLOTS[name].split("|"))
        return str(r.randrange(1, 999)) if choice == "#" else "".join(r.choices("0123456789abcdef", k=r.randrange(8, 17))) if choice == "@" else choice

    return re.sub(r"\{(\w+)\}", one, frame)


def lines(kinds: dict[str, list[str]], each: int, seed: int, without: frozenset[str] = frozenset()) -> list[str]:
    """So many fillings of every frame, as they stand in a text: alone, with an end mark, one after another."""
    r = random.Random(seed)
    out = []
    for kind, frames in sorted(kinds.items()):
        if kind in without:
            continue
        for frame in frames:
            many = max(each, 30 * each) if kind in ("latin", "keys") else each
            out += ["\n" + filled(frame, r) + r.choice(["", ".", ".", "...", "!", "\n"]) for _ in range(many)]
    return out


def placeholders(seed: int, without: frozenset[str] = frozenset()) -> Iterator[str]:
    """Unfilled slots between words, in every bracket that template languages use."""
    r = random.Random(seed)
    case = lambda x: r.choice([x, x, x.upper(), x.capitalize()])
    name = lambda: r.choice([r.choice(SLOT_WORDS), made_word(r), f"{r.choice(SLOT_WORDS)}_{made_word(r)}", f"{made_word(r)} {made_word(r)}", f"{r.choice(SLOT_WORDS)}{r.randrange(30)}", f"{made_word(r)}.{made_word(r)}"])
    around = lambda x: f"{r.choice([made_word(r) + ' ', made_word(r) + ' ', made_word(r) + ' ', '', made_word(r) + ': ', 'S/ '])}{x}{r.choice(['.', ',', ' ' + made_word(r), ' ' + made_word(r), ''])}"
    for shape in BRACKETS:
        if shape not in without:
            for _ in range(120):
                yield around(shape % case(name()))
    for shape in ASKING:
        if shape not in without:
            for ask in ASKS:
                for _ in range(8):
                    yield around(shape % case(ask % name()))
            for _ in range(60 if shape in "[%s]<%s>" else 0):
                yield around(shape % name().upper())
    for mark in MARKS:
        if mark not in without:
            for _ in range(80):
                yield around(case(mark))


def naturals(seed: int) -> Iterator[str]:
    """Brackets, numbers and signs as natural texts have them."""
    r = random.Random(seed)

    def fill(m: re.Match) -> str:
        return {"d": lambda: str(r.randrange(1, 5000)), "w": lambda: r.choice([made_word(r), made_word(r).capitalize()]), "A": lambda: "".join(r.choices("ABCDEGIMNOPRSU", k=r.randrange(2, 6)))}[m[1]]()

    for frame in NATURAL:
        for _ in range(100):
            yield f"{made_word(r)} {re.sub('%([dwA])', fill, frame)}{r.choice([' ', '. ', ', '])}{made_word(r)}"
