"""Vocabularies of genre labels.

The small tables and the Portuguese forms are fixed values. The English vocabulary of a library has many hundred
entries, grown from its own labels, so it is a parameter: `load` reads it from a file of `label<TAB>canonical`
lines (an empty canonical form discards the label). The default here has the commonest labels alone; a plan that
removes rare labels should be given the library's own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Labels that say nothing about a book.
EMPTY_LABELS = (
    "general|geral|ebook|e-book|book|books|livro|livros|misc|miscellaneous|other|outros|diversos|n/a|none|unknown|desconhecido|sem categoria|"
    "literatura geral|fiction general|nonfiction general|adult|all|oficial|comprado|epub|mobi|pdf|club|group|body|success|digital|revisado|"
    "traduzido|completo|colecao|coleção|serie|série|volume|box|nacional|importado|lancamento|lançamento|bestseller|best seller|novo|usado"
).split("|")
# People who appear as labels.
PEOPLE = (
    "chico xavier|francisco candido xavier|francisco cândido xavier|allan kardec|hippolyte leon denizard rivail|hippolyte léon denizard rivail|"
    "emmanuel|andre luiz|andré luiz|meimei|neio lucio|neio lúcio|yvonne a. pereira|publio lentulus|humberto de campos|jesus|deus|maria"
).split("|")
# Countries and cities.
PLACES = (
    "angola|algeria|australia|denmark|egypt|greece|iran|iraq|israel|mozambique|nigeria|south africa|soviet union|lebanon|turkey|mexico|argentina|"
    "chile|cuba|korea|vietnam|afghanistan|poland|sweden|norway|finland|iceland|netherlands|belgium|austria|switzerland|hungary|czech republic|"
    "romania|bulgaria|ukraine|inglaterra|oriente médio|oriente medio|london|berlin|rome|moscow|tokyo|california|texas|florida|chicago|boston"
).split("|")
# Words that stay small inside a label.
SMALL = "de da do das dos e em a o as os para com sem no na and of the".split()


def _pairs(lines: str) -> dict[str, str]:
    return {k.strip(): v.strip() for k, _, v in (line.partition(":") for line in lines.strip().split("\n"))}


# The Portuguese forms; an empty one discards the label.
CANON_PT = _pairs("""
fiction: Ficção
ficcao: Ficção
ficção: Ficção
nonfiction: Não-ficção
non-fiction: Não-ficção
nao-ficcao: Não-ficção
fantasy: Fantasia
fantasia: Fantasia
science fiction: Ficção Científica
sci-fi: Ficção Científica
ficcao cientifica: Ficção Científica
ficção científica: Ficção Científica
ficção científica e fantasia: Ficção Científica
science fiction & fantasy: Ficção Científica
horror: Terror
terror: Terror
thriller: Suspense
suspense: Suspense
thrillers: Suspense
mystery: Mistério
misterio: Mistério
mistério: Mistério
crime: Policial
policial: Policial
true crime: Crime Real
detective: Policial
crime fiction: Policial
romance: Romance
romances: Romance
love stories: Romance
historical: Histórico
historical fiction: Histórico
history: História
historia: História
história: História
biography: Biografia
biografia: Biografia
biography & autobiography: Biografia
autobiography: Autobiografia
memoir: Memórias
memoirs: Memórias
young adult: Jovem Adulto
young adult fiction: Jovem Adulto
ya: Jovem Adulto
juvenile fiction: Infantojuvenil
infanto-juvenil: Infantojuvenil
infantojuvenil: Infantojuvenil
children: Infantil
children's: Infantil
juvenile nonfiction: Infantojuvenil
classics: Clássicos
classicos: Clássicos
clássicos: Clássicos
literary: Literatura
literature: Literatura
literatura: Literatura
literature & fiction: Literatura
literary criticism: Crítica Literária
poetry: Poesia
poesia: Poesia
drama: Drama
teatro: Teatro
adventure: Aventura
aventura: Aventura
action: Ação
acao: Ação
epic: Épico
epico: Épico
philosophy: Filosofia
filosofia: Filosofia
psychology: Psicologia
psicologia: Psicologia
religion: Religião
religiao: Religião
religião: Religião
self-help: Autoajuda
autoajuda: Autoajuda
self help: Autoajuda
business: Negócios
negocios: Negócios
business & economics: Negócios
economics: Economia
economia: Economia
political science: Política
politics: Política
politica: Política
science: Ciência
ciencia: Ciência
ciência: Ciência
technology: Tecnologia
tecnologia: Tecnologia
computers: Computação
computing: Computação
health: Saúde
saude: Saúde
health & fitness: Saúde
cooking: Culinária
culinaria: Culinária
cookbooks: Culinária
travel: Viagem
viagem: Viagem
art: Arte
arte: Arte
music: Música
musica: Música
sports: Esportes
esportes: Esportes
education: Educação
educacao: Educação
law: Direito
direito: Direito
medical: Medicina
medicina: Medicina
short stories: Contos
contos: Contos
essays: Ensaios
ensaios: Ensaios
crônicas: Crônicas
cronicas: Crônicas
war: Guerra
guerra: Guerra
military: Militar
dystopian: Distopia
distopia: Distopia
utopian: Utopia
erotica: Erótico
erotico: Erótico
erótico: Erótico
comics: Quadrinhos
quadrinhos: Quadrinhos
graphic novels: Graphic Novel
manga: Mangá
humor: Humor
comedy: Comédia
social science: Ciências Sociais
sociology: Sociologia
sociologia: Sociologia
anthropology: Antropologia
family: Família
familia: Família
paranormal: Paranormal
supernatural: Sobrenatural
literatura brasileira: Literatura Brasileira
literatura estrangeira: Literatura Estrangeira
romance histórico: Romance Histórico
romance historico: Romance Histórico
contos e crônicas: Contos
espiritismo: Espiritismo
administração: Administração
administracao: Administração
gastronomia: Gastronomia
fotografia: Fotografia
cinema: Cinema
conto: Contos
auto-ajuda: Autoajuda
clássico: Clássicos
classico: Clássicos
poemas: Poesia
poema: Poesia
romantico: Romance
romântico: Romance
romance sobrenatural: Sobrenatural
ficção histórica: Romance Histórico
ficcao historica: Romance Histórico
juvenil: Infantojuvenil
chick lit: Chick-lit
chick-lit: Chick-lit
espiritualismo: Espiritismo
espírita: Espiritismo
espirita: Espiritismo
livro espírita: Espiritismo
doutrina espírita: Espiritismo
codificação espírita: Espiritismo
codificação: Espiritismo
espiritual: Espiritualidade
mind & spirit: Espiritualidade
detetive: Policial
assassinato: Policial
mystery & detective: Mistério
thriller & mystery: Suspense
short stories (single author: Contos
other languages:
personal memoirs: Memórias
biographies & memoirs: Biografia
personal growth: Autoajuda
personal development & self-help: Autoajuda
motivational & inspirational: Autoajuda
politics & social sciences: Política
religion & spirituality: Religião
latin america:
south america:
portugal:
brasil:
contemporary:
ebook company:
by anjo_high_tech:
european:
american:
africa:
asia:
europe:
united states:
england:
france:
germany:
women:
men:
general interest:
world:
international:
""")

# The commonest English forms, a default: a library gives its own vocabulary, of any size, as a file.
CANON_EN = _pairs("""
fiction: Fiction
ficcao: Fiction
ficção: Fiction
novels: Fiction
nonfiction: Nonfiction
non-fiction: Nonfiction
fantasy: Fantasy
fantasia: Fantasy
science fiction: Science Fiction
sci-fi: Science Fiction
scifi: Science Fiction
ficcao cientifica: Science Fiction
horror: Horror
terror: Horror
thriller: Thriller
thrillers: Thriller
suspense: Thriller
mystery: Mystery
misterio: Mystery
mystery thriller: Mystery
mystery & detective: Mystery
crime: Crime
true crime: True Crime
detective: Detective
policial: Detective
romance: Romance
romances: Romance
chick lit: Chick Lit
chick-lit: Chick Lit
historical fiction: Historical Fiction
historical: Historical Fiction
history: History
historia: History
war: War
guerra: War
world war ii: War
military: Military
biography: Biography
biografia: Biography
biography & autobiography: Biography
autobiography: Biography
memoir: Memoir
memoirs: Memoir
young adult: Young Adult
ya: Young Adult
children: Children's
children's: Children's
juvenile fiction: Children's
classics: Classics
classicos: Classics
literature: Literature
literatura: Literature
literary: Literature
literary criticism: Literary Criticism
poetry: Poetry
poesia: Poetry
drama: Drama
theatre: Theatre
teatro: Theatre
short stories: Short Stories
contos: Short Stories
conto: Short Stories
essays: Essays
ensaios: Essays
adventure: Adventure
aventura: Adventure
action & adventure: Adventure
action: Action
acao: Action
dystopian: Dystopia
dystopia: Dystopia
distopia: Dystopia
paranormal: Paranormal
supernatural: Supernatural
ghosts: Ghosts
mythology: Mythology
philosophy: Philosophy
filosofia: Philosophy
psychology: Psychology
psicologia: Psychology
sociology: Sociology
sociologia: Sociology
social science: Social Sciences
anthropology: Anthropology
politics: Politics
politica: Politics
economics: Economics
economia: Economics
business: Business
business & economics: Business
management: Management
science: Science
ciencia: Science
physics: Physics
biology: Biology
mathematics: Mathematics
technology: Technology
tecnologia: Technology
computers: Computing
programming: Programming
religion: Religion
religiao: Religion
christianity: Christianity
spirituality: Spirituality
espiritismo: Spiritism
espirita: Spiritism
mediunidade: Spiritism
self-help: Self-Help
self help: Self-Help
autoajuda: Self-Help
family: Family
health: Health
saude: Health
medicine: Medicine
cooking: Cooking
culinaria: Cooking
sports: Sports
art: Art
arte: Art
music: Music
musica: Music
comics: Comics
quadrinhos: Comics
graphic novels: Graphic Novel
manga: Manga
education: Education
educacao: Education
law: Law
direito: Law
travel: Travel
viagem: Travel
humor: Humor
comedy: Humor
portuguese literature: Portuguese Literature
brazilian literature: Brazilian Literature
literatura brasileira: Brazilian Literature
british literature: British Literature
english literature: British Literature
american literature: American Literature
french literature: French Literature
german literature: German Literature
italian literature: Italian Literature
spanish literature: Spanish Literature
russian literature: Russian Literature
world literature: World Literature
audiobook:
audiobooks:
ebook:
ebooks:
general:
geral:
adult:
book club:
bestseller:
misc:
other:
brazil:
brasil:
france:
england:
germany:
italy:
spain:
europe:
asia:
africa:
united states:
american:
european:
medieval:
victorian:
spanish:
french:
german:
italian:
portuguese:
english:
foreign language study:
""")

# Translations of labels that outside sources return.
TAGS_PT = _pairs("""
fiction: Ficção
nonfiction: Não-ficção
non-fiction: Não-ficção
fantasy: Fantasia
science fiction: Ficção Científica
sci-fi: Ficção Científica
horror: Terror
thriller: Suspense
mystery: Mistério
crime: Policial
romance: Romance
historical: Histórico
history: História
biography: Biografia
autobiography: Autobiografia
memoir: Memórias
young adult: Jovem Adulto
juvenile fiction: Infantojuvenil
children: Infantil
classics: Clássicos
literary: Literatura
poetry: Poesia
drama: Drama
adventure: Aventura
epic: Épico
philosophy: Filosofia
psychology: Psicologia
religion: Religião
self-help: Autoajuda
business: Negócios
economics: Economia
politics: Política
science: Ciência
technology: Tecnologia
computers: Computação
health: Saúde
cooking: Culinária
travel: Viagem
art: Arte
music: Música
sports: Esportes
education: Educação
law: Direito
medical: Medicina
short stories: Contos
essays: Ensaios
war: Guerra
dystopian: Distopia
suspense: Suspense
erotica: Erótico
comics: Quadrinhos
graphic novels: Graphic Novel
humor: Humor
true crime: Crime Real
social science: Ciências Sociais
family: Família
detective: Detetive
action: Ação
paranormal: Paranormal
supernatural: Sobrenatural
""")


def load(spark: SparkSession, path: str) -> dict[str, str]:
    """A vocabulary from `label<TAB>canonical` lines; a table of labels is small by nature."""
    lines = spark.read.text(path).where(F.contains("value", F.lit("\t")))
    parts = F.split("value", "\t", 2)
    return {r["k"]: r["v"] for r in lines.select(F.lower(F.trim(parts[0])).alias("k"), F.trim(parts[1]).alias("v")).collect()}


def table(spark: SparkSession, vocabulary: dict[str, str]) -> DataFrame:
    return spark.createDataFrame(sorted(vocabulary.items()), "label string, canonical string")
