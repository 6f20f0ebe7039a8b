"""The small labelled table for the personal-information tagger: sentence patterns with typed slots, filled by rule.

Every row is a text whose spans are known because its slots were filled. Names, streets and hosts are common public ones of
several countries, and more than half of the name words are made anew, letter by letter, from the letter sequences of those
lists, so that a word says little and its form and surroundings say more. Nothing here was taken from the documents that
the tagger is run on; a test holds the patterns and lists against them. Fixed values below.
"""

from __future__ import annotations

import random
import re
from collections import defaultdict

FIRST = (
    "James Mary Robert Linda David Susan Thomas Karen Charles Nancy Daniel Betty Matthew Helen Anthony Sandra Mark Ashley Paul Emily Steven Donna Andrew Carol Kevin Amanda Brian Melissa George Deborah "
    "Edward Laura Ronald Rebecca Timothy Sharon Jason Cynthia Jeffrey Kathleen Ryan Amy Gary Angela Stefan Sabine Jürgen Monika Uwe Petra Wolfgang Renate Dieter Birgit Heike Matthias Anja Torsten Silke "
    "Günther Katrin Ulrich Nicole Lukas Jean Pierre Nathalie Michel Isabelle Philippe Sylvie Alain Catherine Patrick Martine Julien Céline Thierry Aurélie Benoît Élodie Yves Chantal Étienne Margaux José Carmen "
    "Antonio Pilar Manuel Dolores Javier Lucía Alejandro Marta Sergio Beatriz Ángel Rocío Iñigo Inés Álvaro Nuria Enrique Soledad Giovanni Chiara Marco Giulia Piotr Agnieszka Krzysztof Joanna Lars Astrid Mikael Sigrid "
    "Ahmed Layla Omar Aisha Yusuf Khadija Hassan Mariam Rajesh Anjali Vikram Lakshmi Arjun Meera Hiroshi Yuki Takeshi Akiko Jun Min Ling Xiu Olga Dmitri Svetlana Nikolai Emeka Ngozi Kwame Abena Tunde Chidi"
).split()
LAST = (
    "Smith Jones Brown Davis Miller Wilson Moore Taylor Anderson Jackson White Harris Martin Thompson Robinson Clark Lewis Walker Young King Wright Scott Green Baker Adams Nelson Carter Mitchell Turner Phillips "
    "Campbell Parker Evans Edwards Collins Stewart Morris Rogers Cook Morgan Bell Murphy Bailey Cooper Müller Schneider Fischer Weber Meyer Wagner Becker Schulz Hoffmann Koch Bauer Richter Klein Wolf Schröder Neumann "
    "Schwarz Zimmermann Krüger Hofmann Lange Krause Lehmann Köhler Maier Vogel Keller Friedrich Günter Roth Dupont Durand Moreau Laurent Simon Leroy Roux Fournier Girard Bonnet Mercier Blanchard Gauthier Chevalier Perrin "
    "García Fernández González Rodríguez López Martínez Sánchez Pérez Gómez Jiménez Ruiz Hernández Díaz Moreno Álvarez Romero Navarro Torres Domínguez Vázquez Rossi Russo Ferrari Esposito Bianchi Kowalski Nowak Wiśniewski "
    "Andersen Johansson Nilsson Karlsson Virtanen Ivanov Petrov Sokolova Popescu Horvat Novák Nagy Yılmaz Demir Khan Singh Sharma Gupta Reddy Iyer Tanaka Sato Suzuki Watanabe Kim Park Choi Chen Liu Huang Nguyen Tran "
    "Okafor Mensah Adeyemi Diallo Haddad Rahman Hussein Cohen Levy Silva Santos Oliveira Costa Pereira Byrne Gallagher Kavanagh MacDonald McCarthy Fitzgerald"
).split()
PARTICLES = ["van ", "van den ", "van der ", "von ", "von der ", "de ", "de la ", "del ", "di ", "al-", "El ", "Le ", "O'", "O’", "D'", "Mc", "Mac", "St. "]
TITLES = ["Dr. ", "Prof. ", "Mr. ", "Mrs. ", "Ms. ", "Mr ", "Dr ", "Frau ", "Herr ", "Herrn ", "Herr Dr. ", "Mme ", "M. ", "Monsieur ", "Madame ", "Sr. ", "Sra. ", "Don ", "Señora ", "Sir ", "Professor "]
STREET = "Maple Cedar Elm Station Church Park Victoria Highfield Washington Lincoln Lake Hill Spring River Sunset Chestnut Birch Kingsway Meadow Orchard Bridge Windsor Franklin Magnolia Forest Grange".split()
ROADS = "Street St St. Road Rd Rd. Avenue Ave Ave. Lane Ln Drive Dr Dr. Way Boulevard Blvd Court Ct Close Place Pl Square Terrace Crescent Row Parkway Gardens Grove Walk".split()
DE_STEM = "Bahnhof Haupt Schiller Goethe Berg Garten Linden Kirch Schul Wald Ring Mozart Ulmen Rosen".split()
DE_END = "straße str. strasse weg gasse platz allee ufer ring damm".split()
DE_LONG = ["Am Markt", "An der Alten Mühle", "Auf dem Hügel", "Im Winkel", "Zur Linde", "Am Stadtpark", "Unter den Eichen", "Hinter der Kirche", "Zum Sportplatz", "Am Kleinen Bach", "Vor dem Tor"]
FR_ROAD = ["rue", "avenue", "boulevard", "place", "chemin", "quai", "impasse", "allée", "cours"]
FR_NAME = ["de la République", "Victor Hugo", "des Lilas", "du Moulin", "de la Gare", "Pasteur", "des Écoles", "du Général Leclerc", "Saint-Michel", "des Rosiers", "de Verdun", "du Château"]
ES_ROAD = ["Calle", "calle", "C/", "Avenida", "Av.", "Plaza", "Paseo", "Camino", "Ronda", "Travesía"]
ES_NAME = ["Mayor", "de Alcalá", "del Sol", "San Juan", "de la Constitución", "Real", "del Prado", "Gran Vía", "de los Olmos", "Nueva", "del Carmen"]
TOWNS = "Springfield Bristol Portland Leeds Austin Denver Cardiff Dublin Chicago Boston Berlin München Köln Hamburg Leipzig Paris Lyon Nantes Lille Madrid Sevilla Valencia Bilbao Utrecht Wien Zürich".split()
HOSTS = "gmail.com yahoo.com outlook.com hotmail.co.uk web.de gmx.net orange.fr free.fr telefonica.es empresa.com acme.com company.org university.edu research.ac.uk firma.de correo.es post.ch proton.me".split()
#: Words that make names of companies, teams and the like; they are no cases.
THINGS = (
    "Northern Atlas Summit Phoenix Falcon Orion Mercury Delta Apex Beacon Horizon Pioneer Vanguard Liberty Crystal Amber Silver Golden Iron Copper Oak Willow Cedar Eagle Raven Fox Stone Harbor Canyon Valley Prairie "
    "Southern Eastern Western Central Royal Grand New Great Blue Red Green Black Bright Quiet Long High Deep Swift Anvil Lantern Compass Anchor Hammer Kettle Saddle Bramble Clover Nettle Ivy Fern Moss Pebble Quarry"
).split()
TEAMS = "team|group|committee|office|unit|board|fund|council|department|branch|squad|working group|review board".split("|")

#: {N} name, {T} name with a title, {E} e-mail, {P} phone, {D} identity number, {A} address. No cases: {J} company or project,
#: {G} team, {R} registered project name, {9} number, {X} a number of another kind, {W} town.
SENTENCES = """
Minutes were taken by {N} and {N}.
Approved by {N} on Monday.
Written by {N}.
by {N}
Signed, {N}
Signed: {N}
signed {N}
Signature: {N}
Checked by {N}, countersigned by {N}.
The draft was corrected by {N} after the meeting.
Author: {N}
Name: {N}
name {N}, phone {P}
My manager {N} told me to wait.
I spoke with {N} yesterday about the invoice.
Please forward this to {N} before noon.
please send it to {N} today
Has anyone heard from {N}?
{N} called this morning.
{N} wants to be removed from the mailing list.
{N} no longer works here.
{N} did not attend and asked for the slides.
{N} has asked to see the file.
{N} lives at {A}.
{N}, who joined in May, will take over from {N}.
According to {N}, the delivery was late.
{T} will present the results.
{T} wants to be removed from the mailing list.
{T} phoned and asked to be called back.
We thank {T} and {T} for their comments.
The patient, {N}, was born in 1974.
Dear {N},
Dear {T},
hi {N}, are you there
Best regards, {N}
Kind regards,
{N}
thanks {N}
thanks, {N}
cheers, {N}
ask {N} in accounting
ask {N} about it please
talk to {N} or {N} first
Attendees: {N}, {N} and {N}
To: {N} <{E}>
From: {N} <{E}>
From: "{N}" <{E}>
Cc: {N} <{E}>; {N} <{E}>
from {N} <{E}>
cc {E}
cc: {E}; {E}
bcc {E}, {E}
mailto:{E}
email {E} or phone {P}
write {E} or {P} please
{E} or {P}
write to {E} please
Contact: {E}
My e-mail is {E}.
Mail {N} ({E}) or ring {P}.
Further questions should be sent to {N} ({E}).
Reach {N} on {P}.
Phone: {P}
Tel. {P}
tel {P}
Fax: {P}
mobile {P}, home {P}
you can call me at {P} after six
call {P} when the courier arrives
text me at {P}
My number is {P}, please ring.
Call our office at {P} or write to {E}.
Contact {N} on {P} before Friday.
Social security number: {D}
SSN {D}
the card shows personal number {D} and mobile {P}
Applicant gave citizen number {D}.
social number {D} does not fit {N}
her passport no. is {D}
passport {D} expires soon
National insurance number {D} belongs to {N}.
tax number {D} is not known to us
Tax ID {D} was not accepted.
ref {D} is not {N}
reference {D} fits {N}
Document {D}, e-mail {E}
The number {D} belongs to {N}.
my id is {D}, can you look it up?
user: it says {D} on my card
The form gives the identity number {D} and the phone {P}.
Copy of passport: {N}, {A}, number {D}.
Applicant {N}, {A}, ID {D}.
File of {N}: {A}, identity no. {D}.
Driving licence {D} seen.
Please deliver to {A}.
Deliver the parcel to {N}, {A}. Phone {P}
Post it to {N}, {A}.
Invoice address: {A}
The office is at {A}.
The bill went to {A}.
he stayed at {A} over winter
her flat is {A}
Our new address is {A}.
We moved to {A} last year.
they moved to {A} in June
she lives at {A} now
A letter was returned from {A}.
{A}
{N}, {A}
{N}
Meine Adresse: {A}.
Anschrift {N}, {A}
Er wohnt in der {A}.
Die Firma sitzt jetzt {A}.
Bitte wenden Sie sich an {N}, Telefon {P}.
Auskunft erteilt {N}, Tel. {P}.
Fragen bitte an {N} ({E}).
Bearbeitet von {N}.
Geprüft von {N}.
Geprüft durch {T}.
Unterzeichnet von {T}.
Sehr geehrter {T},
Mit freundlichen Grüßen
{N}
{N} hat gestern angerufen.
Ausweisnummer {D} wurde vorgelegt.
Pass-Nr. {D} anbei
Steuer-Nr. {D} fehlt noch; Fax {P}
Unterlage {D}; Schreiben an {E}.
Kartennr. {D}
Die Steuernummer {D} gehört {N}.
Personalausweis {D}; E-Mail {E}.
Adresse de livraison : {A}.
Elle habite {A}.
Le siège est situé {A}.
Rédigé par {N}.
Vu par {T}.
Signé par {N}.
Merci de contacter {N} au {P}.
Contact : {N}, {E}
Contact : {N}, tél. {P}.
Numéro de passeport {D}, téléphone {P}.
Carte d'identité no {D}, tél. {P}.
Passeport no {D}, tél. {P}.
Carte no {D}.
{N} a rappelé ce matin.
Veuillez écrire à {N}, {A}.
Dirección: {A}.
Vive en {A}.
La oficina está en {A}.
Firmado por {N}.
Aprobado por {N}.
Escrito por {T}.
Para más información, llame a {N}, teléfono {P}.
Preguntas a {N}, tel. {P}.
Escriba a {N} ({E}).
Pasaporte {D}; correo electrónico {E}.
Certificado {D}, correo {E}.
Cédula {D}
DNI {D}, domicilio {A}.
Estimado {T}:
{N} llamó por la mañana.
""".strip().split("\n")
#: Texts without cases, in four languages, with numbers and capitals of all sorts.
PLAIN = """
{R} is in the news again, item #{9}.
{R} is mentioned in the report, see item #{9} of the list
{R} looked at the same figures and found no change.
{R} examined the second half and found it lower.
People at {R} expect prices to fall by spring.
Experts at {R} see growth next year.
The text was released by {R} for the whole group.
Project {R}: late tasks in the plan, ticket #{9}-{9}.
{R} {G}: meeting moved, room {9}
the {R} {G} agreed with the {R} plan.
{J} is in the news again, see page {9}.
{J} opened an office in {W}.
{J} Ltd. and {J} Inc. signed a contract.
Analysts at {J} expect lower rates.
The {J} {G} meets on Tuesday.
Project {J} starts in week {9}.
The {J} report lists {9} errors on page {9}.
What does the {J} study say about table {9}?
Who approved the budget of project {J} on day {9}?
Part no. {X} is out of stock.
Batch {X} passed inspection, version {9}.{9}.{9}.
lot {X}, released on build {9}.{9}.
The parcel has lot number {X} and the status is open.
Order #{9} was shipped in {9} boxes.
Ticket {9}-{9} is closed. Severity high.
The temperature rose from 12.{9} to 18.{9} degrees at noon.
A share of 0.{9} was bought at 0.{9} and sold at 0.{9}.
Volume was {9}k shares at ${9},{9} each.
back in {9} minutes, around 14:{9}
from 09:15:00 to 17:30:45, {9} trades
{9} of {9} tests failed in run {9}.
size {9} at {9}.{9}, limit {9}
Section {9} explains why the method was changed.
Table {9} and Figure {9} show the results by region.
See chapter {9}, paragraph {9}, and the appendix.
hash 0x3fa9c1d27be4 was confirmed in block {9}
commit 9f3ab2c fixes issue #{9}
open docs/guide_{9}.md and read line {9}
{H} {H} {9}
please drop order {H}, thank you
pls hold {H}, thx
hold batch {H}, thanks
remove {H}, ok
the <b>{o}</b> was {o}
**{O}** {o} and <b>{O}</b> the {o} {o}
<i>{o} {o}</i> &amp; {o}
see docs/{H}.md#{9} for the rest
[source: audit/{H}.md#{9}]
{K} {9}.{9}/{9}.{9}, {K} 0.{9}
{K} rose at noon, mid 0.{9}
Monte Carlo results with {9} draws are in Table {9}.
A Monte Carlo study was run.
function(x={9}, y={9}) returns 0.{9}
The address 192.168.{9}.{9} is internal.
IBAN DE89 3704 0044 0532 0130 00 is the account of the club.
ISBN 978-3-16-148410-0, second edition
P.O. Box {9} is closed.
Room {9}, floor {9}, bring your badge.
meet in room {9} of the main building at 10:30
Ticker ABCD-22MAR-T{9} closed at {9}.
wallet 0x{H} belongs to the treasury
please cancel order {H}, thanks
ok, I will send the new version
anyone here who can restart the server @ rack {9}?
Why is the result different? I guess the data were late.
Version {9} of the document replaces version {9}.
The Federal Reserve left rates unchanged in March.
The European Central Bank and the Bank of England met in July.
In January and February the index fell by {9} percent.
The Monday session was quiet; Wednesday and Friday were busier.
A Bayesian model with a Gaussian prior was fitted with {9} draws.
Black Scholes prices and Sharpe ratios are listed in Table {9}.
The Nash equilibrium and the Kelly rule are standard.
Our estimate uses Student t errors and a Newton step.
# Annual Report Summary {9}
# Weekly Sales Forecast {9}
## Data Model Overview
# Market Data Review {9}
# F-Score Table {9}
# {O}-Score Overview {9}
A small part of {o} and a larger part of {o} {o}
A {o} {o} and a {o} {o} were seen
# User Guide part {9}
Market Data Service
Quarterly Business Update
Not To Be Opened Before Use
NOTE: THIS DOCUMENT IS FOR INTERNAL USE ONLY
End of file.
We do not give advice. Past results say little about the future.
Half of the answers were right; the others had the wrong sign.
Our reading is that demand fell because prices rose.
The text of July stands, with a softer view of housing.
A softer tone and a longer pause were expected.
Members of the board saw risks to growth as balanced.
The gap between the two series widened after the announcement.
If the weather holds, the harvest will be early.
Given that the second team disagreed on {9} of {9} cases, is the result still valid?
Give the answer in one sentence and leave the table out.
What share of the {9} entries was lost when the server restarted?
user: is it possible to change my plan?
user: ok then cancel the order
assistant: the rate is {9} percent [source: files/a1b2.md#{9}].
tool: search(query={9}) -> {9} results
tool: read_file(notes/x7.txt) returned {9} lines.
Der Bericht vom März wurde ersetzt. Die Prüfung fand {9} Fehler.
Die Rate lag im Mai bei {9} Prozent, der alte Wert bei {9}.
Der Vertrag gilt ab August, die Frist endet um 12:30 Uhr.
Für den Auftrag wurden {9} Stück zu 0.{9} geliefert.
Stichwort Lager: {9} Zeilen, davon {9} doppelt.
Liste {O}: {9} Zeilen, {9} leer.
Der {U} zur {U} blieb offen.
Der {U} zum {O} wurde im Mai nicht geändert.
Die {U} gilt weiter. Das {U} fehlt.
Im {U} steht der {U} vom Juni.
Le {u} de {u} est clos. La {u} reste ouverte.
El {u} de {u} sigue igual. La {u} no cambia.
The {U} of the {U} was replaced.
# {U}-{U} Notes {9}
# {U} {U} {9}
## {O} {U} Summary {9}
{O}: {9} Stück, {9} Kisten
Der {O} wurde ersetzt. Die {O} bleibt.
Das {O} {K} lag zuletzt bei 0.{9}.
Siehe {O}, Seite {9}.
Voir {o} : {o} {o}, page {9}.
Ver {o}: {o} {o}, página {9}.
Véase asimismo: {u} {o}, punto {9}.
Véase asimismo: {u} {u}, punto {9}.
Consúltese: {u} {u}, hoja {9}. La {u} halló {9} {u}.
Voir aussi : {u} {u}, feuille {9}.
Siehe auch: {u} {u}, Blatt {9}.
# {O} {O} {9}
# {O}-{O} Notes {9}
the {o} {o} is {o} again
the {o}-{o} {o}; {o} {o}; the {o}
A {o}-{o} change in {o}.
bring the {o} {o}
Im Abschnitt {9} (Anhang, Nr. {9}) fehlen {9} Stunden.
Die Sitzung des Ausschusses fand am Montag statt. Der Vorsitz wechselte.
Siehe auch: Handbuch, Kapitel {9}. Die Tabelle zeigt den Verlauf.
Das Ergebnis bleibt offen, weil die Daten fehlen.
Die Notiz vom Juli behält den alten Ton. Der Posten bleibt gesperrt.
Der Auftrag {K} lag im Juni bei {9}.
Der Kurs fiel um {9} Punkte. Wir sehen darin keinen Vorteil, sondern Kosten.
Unser Modell rechnet mit {9} Fenstern; nur {9} liegen über 0.{9}.
Die Zahl der offenen Punkte stieg im Januar auf {9}.
Le rapport de mars remplace celui de février, page {9}.
La note de juillet conserve une position neutre sur l'emploi.
Voir encore : table annuelle, partie {9} ; feuille fermée, partie {9}.
Le conseil garde un ton prudent. L'écart est passé de 0.{9} à 0.{9}.
Le contrôle a trouvé {9} erreurs (annexe {9}).
Voir aussi : base de données, chapitre {9}.
Nous lisons cette hausse comme un effet de saison.
Le prix était de 0.{9} avant la réunion de juin.
Sur {9} essais, seuls {9} sont valables.
El informe de marzo sustituye al de febrero, página {9}.
La nota de octubre conserva el texto anterior.
El acta de julio repite un mensaje neutral sobre el empleo.
Ver también: tabla mensual, sección {9}; serie cerrada, sección {9}.
El cuadro de enero muestra una baja leve.
La orden de septiembre sigue abierta y la de mayo vencida.
La revisión encontró {9} errores (anexo {9}).
Véase también: base de datos, capítulo {9}.
El precio cerró en 0.{9} después de la reunión de junio.
De {9} pruebas, solo {9} son válidas.
El margen entre 0.{9} y 0.{9} no supone ganancia.
El Banco Central mantuvo el tipo en abril.
Las cifras de enero subieron {9} puntos.
The file of {W} was closed. The train to {W} leaves at {9}.
Section 8 of the Highways Act applies to every street and road in the county.
The way in which the court decides is a matter of place and time.
call the function {9} times and wait {9} seconds
The number of users is {9}; the number of orders is {9}.
my order is {9}, my size is {9}
""".strip().split("\n")
#: Parts of sentences into which a name or, as no case, a thing is put.
VERBS = "spoke approved believes remains appears plays teaches studied drove cooked visited sent signed found wrote says runs leads heads chairs manages owns sold bought built drew read took gave made came went stood got put kept held felt told said wrote asked agreed replied reported resigned signed left arrived explained noted confirmed denied joined called refused moved works lives waited smiled won lost is was has will can should did knows thinks wants".split()
TAILS = (
    "the report|the contract|a letter|the invoice|the notes|about the results|the meeting|the plan|on Friday|last week|yesterday|for two hours|to the office|from home|in the morning|again|that prices fell|to be called back|"
    "not to come|at the door|with the others|for help|in March|to leave the group|to see the account|this year|and left|of the list|off the record|with the number"
).split("|")
BEFORE = (
    "a letter from|the call with|on behalf of|sold to|owed by|in the name of|together with|a reply by|taken by|seen by|read by|handled by|introduced by|witness|owner:|contact person:|the second witness was|tutor|asked for|ask for|looking for|"
    "belongs to|matches|does not belong to|is not|same as|regards to|first reader|second signature|accountant|our colleague|the lawyer|the tenant|the nurse|second examiner|lead auditor|co-author|deputy|chair|translator|proofreader|other reader|third referee|driver|host|examiner|trainee|inspector|fails to match|match|account of|file of|care of|c/o|says|said|asks|answers|writes|thanks to|thanks|regards|cheers|not|but|as|like|than|attention|attn.|for|with|and|or|by|to|from|of"
).split("|")
FOREIGN = (
    "{N} hat den Vertrag unterschrieben.|{N} sprach mit {N} darüber.|{N} bittet um Rückruf.|{N} parle avec {N} du dossier.|{N} demande un rappel.|{N} a envoyé les clés.|{N} habló con {N} ayer.|{N} pide una llamada.|Das Schreiben von {N} kam gestern.|Die Akte gehört {N}, nicht {N}.|Gespräch mit {T} am Dienstag|{N} ist krank und kommt morgen.|Im Auftrag von {N}|Verantwortlich: {N}|Zeuge war {N}.|"
    "{N} a signé le contrat.|La lettre de {N} est arrivée hier.|Le dossier de {N} est complet.|Entretien avec {T} mardi|{N} est malade et viendra demain.|Pour toute demande : {N}|Responsable : {N}|Le témoin était {N}.|"
    "{N} firmó el contrato.|La carta de {N} llegó ayer.|El expediente de {N} está completo.|Reunión con {T} el martes|La señora {N} llegó tarde.|{N} está enfermo.|Responsable: {N}|El testigo era {N}."
).split("|")
#: Words that stand for a thing where a name might be.
NOUNS = (
    "the committee|the second team|The committee|Most members|Both sides|The new clerk|head office|the desk|a friend|the label|the model|Prices|Two rows|The Data Team|Customer Service|hand|noon|the server|a colleague|help|the first leg|"
    "nobody|the night shift|the usual place|Der Ausschuss|Die Spedition|Das Lager|Der Kurs {K}|Die Aktie {K}|Der Posten {K}|Le comité|La banque|Le titre {K}|L'entrepôt|El comité|La empresa|El título {K}|A Monte Carlo run|"
    "A Gaussian prior|The Kelly rule|The Black Friday sale|{K}|{K} and {K}|{J}|The {J}|the {J} {G}|order {H}|file {H}|wallet 0x{H}|{H}.md|room {9}|step {9}|build {9}.{9}|lot {X}|batch {X}|serial {X}|index|the list|later"
).split("|")
#: Given to the tagger as names of projects in training; at work the caller's register takes their place.
REGISTER = ("Silver Falcon", "Northern Kettle", "Great Bramble", "Amber Saddle", "Old Lantern", "Hadley Brook", "Cinder Plover", "Port Anvil", "Marlowe")


class Filler:
    """Fills the slots of a pattern; the same seed gives the same table. made: share of name words made letter by letter."""

    def __init__(self, seed: int, made: float = 0.6, words: list[str] | None = None) -> None:
        self.r = random.Random(seed)
        self.words = words or "price table report window number label signal index archive balance".split()
        self.made = made
        self.chains = [self._chain(FIRST), self._chain(LAST)]

    @staticmethod
    def _chain(words: list[str]) -> dict[str, list[str]]:
        """Letters that follow two letters in the words."""
        after: dict[str, list[str]] = defaultdict(list)
        for w in words:
            s = "^^" + w.lower() + "$"
            for k in range(2, len(s)):
                after[s[k - 2 : k]].append(s[k])
        return after

    def word(self, which: int) -> str:
        """A name word: one of the list, or one with the same letter sequences, or of loose syllables."""
        r, x = self.r, self.r.random()
        if x > self.made:
            return r.choice((FIRST, LAST)[which])
        if x < self.made / 3:  # sounds of no language in particular
            return "".join(r.choice(["", "b", "br", "bl", "d", "dr", "f", "fr", "g", "gr", "gl", "h", "j", "k", "kr", "kh", "l", "m", "n", "p", "pr", "qu", "r", "s", "sc", "sch", "sk", "st", "sz", "t", "th", "tr", "thr", "v", "w", "y", "z"]) + r.choice(["a", "e", "i", "o", "u", "a", "e", "i", "o", "y", "ø", "é", "ei", "ou"]) + r.choice(["", "", "n", "r", "l", "ss", "tt", "m", "k"]) for _ in range(r.choice([1, 2, 2, 3]))).capitalize() + r.choice(["", "", "a", "o", "e", "y", "en", "er", "in", "is", "ov", "nd", "ck", "gt", "rup", "sz", "tz", "lt", "lle", "cz"])
        while True:
            s = "^^"
            while not s.endswith("$") and len(s) < 13:
                s += r.choice(self.chains[which][s[-2:]])
            s = s.strip("^$")
            if 3 <= len(s) <= 10:
                return s.capitalize()

    def digits(self, n: int) -> str:
        return "".join(str(self.r.randrange(10)) for _ in range(n))

    def letters(self, n: int) -> str:
        return "".join(self.r.choice("ABCDEFGHIJKLMNOPRSTUVWXYZ") for _ in range(n))

    def loose(self) -> str:
        """A pattern of loose parts: a name or a thing before a verb or behind a word that often leads to one."""
        r = self.r
        who = (lambda: "{T}" if r.random() < 0.12 else "{N}") if r.random() < 0.68 else (lambda: r.choice(NOUNS))
        x = r.random()
        if x < 0.2:
            return r.choice(FOREIGN) if r.random() < 0.7 else re.sub(r"{[NT]}", lambda m: r.choice(NOUNS), r.choice(FOREIGN))
        if x < 0.55:
            text = f"{who()} {r.choice(VERBS)} {r.choice(TAILS)}"
        elif x < 0.85:
            text = f"{r.choice(BEFORE)} {who()}" + r.choice(["", "", f" {r.choice(VERBS)} {r.choice(TAILS)}", f" {r.choice(TAILS)}", f", {r.choice(TAILS)}", f" and {who()}", f", {r.choice(BEFORE)} {who()}"])
        else:
            text = f"{r.choice(TAILS)}, {r.choice(BEFORE)} {who()}"
        if r.random() < 0.5 and text[0] != "{":
            text = text[0].upper() + text[1:]
        return text + r.choice([".", ".", ".", "", ";", "?", ":"])

    def salad(self) -> str:
        """Words of no meaning: nothing in them is a case, whatever they stand beside."""
        r, out = self.r, []
        pick = lambda: r.choice(self.words) if r.random() < 0.9 else r.choice(self.words) + "-" + r.choice(self.words)
        x = r.random()
        if x < 0.15:
            return r.choice(["# ", "## ", "", "- "]) + " ".join(pick().capitalize() for _ in range(r.choice([2, 3, 4]))) + r.choice(["", f" {self.digits(2)}", ":"])
        for k in range(r.randrange(4, 16)):
            y = r.random()
            w = pick()
            if y < 0.06:
                w = self.digits(r.randrange(1, 4))
            elif y < 0.1:
                w = f"0.{self.digits(3)}"
            elif y < 0.18 and x < 0.5:  # nouns as German has them
                w = r.choice(["der", "die", "das", "im", "den"]) + " " + (r.choice(self.words) + r.choice(["", r.choice(self.words)])).capitalize()
            elif y < 0.2:
                w = self.plain("K")
            out.append(w.capitalize() if not k and x < 0.8 else w)
            if r.random() < 0.1:
                out[-1] += r.choice([",", ";", ":", " -", "?"])
        return " ".join(out) + r.choice([".", ".", "", ";"])

    def surname(self) -> str:
        r, x = self.r, self.r.random()
        one = self.word(1)
        if x < 0.1:
            return one + "-" + self.word(1)
        if x < 0.15:
            return one + " " + self.word(1)
        return r.choice(PARTICLES) + one if x < 0.28 else one

    def name(self) -> str:
        r, first, last = self.r, self.word(0), self.surname()
        if r.random() < 0.06:
            first += "-" + self.word(0)
        middle = f" {r.choice('ABCDEFGHJKLMPRSTW')}." if r.random() < 0.14 else ""
        x = r.random()
        out = f"{first[0]}. {last}" if x < 0.16 else f"{first[0]}.{middle[1:]} {last}" if x < 0.19 else f"{last}, {first}" if x < 0.34 else f"{last}, {first[0]}." if x < 0.37 else f"{first}{middle} {last}"
        y = r.random()
        return out.upper() if y < 0.1 else out.lower() if y < 0.2 else out

    def email(self) -> str:
        r = self.r
        fold = lambda w: "".join(c for c in w.lower() if c.isascii() and c.isalpha()) or "info"
        a, b = fold(self.word(0)), fold(self.word(1))
        local = r.choice([f"{a}.{b}", f"{a}_{b}{self.digits(2)}", f"{a[0]}{b}", f"{b}+news", f"{b}.{a[0]}-x", f"{a}{self.digits(r.randrange(1, 5))}", f"{a}-{b}", f"{a}.{b}+{r.choice(['lists', 'shop', 'work'])}", f"{b}+{r.choice(self.words)}", b, f"{a}_{b}", f"{b}.{a[0]}-{self.r.choice('abxyz')}", f"{a}.{b}", "info", f"{a}.de.{b}"])
        host = r.choice(HOSTS) if r.random() < 0.5 else fold(self.word(1)) + r.choice([".com", ".org", ".net", ".de", ".co.uk", ".fr", ".es", ".io", ".example", ".test", ".invalid", ".info"]) if r.random() < 0.6 else r.choice(self.words) + r.choice([".com", ".net", ".example", ".invalid", ".local", ".eu"])
        if r.random() < 0.2:
            host = r.choice(["mail.", "smtp.", "desk."]) + host
        x = r.random()
        at, dot = ("@", ".") if x < 0.74 else r.choice([(" (at) ", "."), (" [at] ", " [dot] "), (" (at) ", " (dot) "), ("(at)", "(dot)"), (" [at] ", "."), ("[at]", ".")])
        out = local + at + host.replace(".", dot)
        return out.upper() if r.random() < 0.08 else out

    def phone(self) -> str:
        """Forms of the US, UK, Germany, France, Spain and others, with national or international prefix."""
        r, d = self.r, self.digits
        a, b, sep = f"{r.randrange(2, 10)}{d(2)}", f"{r.randrange(2, 10)}{d(2)}", r.choice("-- .")
        us = r.choice([f"({a}) {b}-{d(4)}", f"{a}{sep}{b}{sep}{d(4)}", f"1{sep}{a}{sep}{b}{sep}{d(4)}", f"+1{r.choice(['-', ' ', ' ('])}{a}{r.choice('-')}{b}-{d(4)}".replace("(" + a + "-", "(" + a + ") "), f"+1{a}{b}{d(4)}", f"{a}-{b}-{d(4)} {r.choice(['x', 'ext. ', 'ext '])}{d(3)}", f"({a}){b}-{d(4)}", f"+1 {a} {b} {d(4)}"])
        cc = r.choice(["44", "49", "33", "34", "39", "31", "41", "43", "48", "46"])
        groups = r.choice([(2, 4, 4), (3, 3, 4), (2, 3, 4), (1, 2, 2, 2, 2), (3, 3, 3), (2, 5, 3), (4, 6), (2, 7), (3, 6), (2, 2, 2, 3), (3, 7), (4, 3, 3)])
        body = [d(n) for n in groups]
        intl = r.choice(["+", "+", "+", "00"]) + cc + r.choice([" ", " ", " ", "-"]) + r.choice([" ".join(body), "-".join(body), f"{body[0]} {''.join(body[1:])}", f"(0){body[0]} {''.join(body[1:])}", f"{body[0]}/{''.join(body[1:])}"])
        nat = "0" + r.choice([" ".join(body), "/".join([body[0], "".join(body[1:])]), "-".join([body[0], "".join(body[1:])]), f"{body[0]} {''.join(body[1:])}"])
        fr = f"0{r.randrange(1, 10)}" + "".join(r.choice([" ", " ", ".", "-"])[0] + d(2) for _ in range(1)) + f" {d(2)} {d(2)} {d(2)}"
        par = f"(0{d(r.choice([2, 3, 4]))}) " + r.choice([d(6), f"{d(3)} {d(4)}", f"{d(5)}-{d(3)}", f"{d(4)} {d(3)}", f"{d(3)}-{d(4)}"])
        es = r.choice("6789") + d(2) + " " + r.choice([f"{d(3)} {d(3)}", f"{d(2)} {d(2)} {d(2)}"])
        return r.choice([us, us, us, intl, intl, nat, fr, par, es])

    def identity(self) -> str:
        """Numbers of persons: US, UK, German, Spanish, French and passport forms."""
        r, d = self.r, self.digits
        letters = "ABCEGHJKLMNPRSTWXYZ"
        two = r.choice(letters) + r.choice(letters)
        return r.choice([f"{d(3)}-{d(2)}-{d(4)}", f"{d(3)}-{d(2)}-{d(4)}", f"{d(3)} {d(2)} {d(4)}", f"{two} {d(2)} {d(2)} {d(2)} {r.choice('ABCD')}", f"{two}{d(6)}{r.choice('ABCD')}", f"{two}{d(7)}", f"{r.choice(letters)}{d(8)}", f"{d(2)} {d(3)} {d(3)} {d(3)}", f"{d(8)}{r.choice(letters)}", f"{r.choice('XYZ')}{d(7)}{r.choice(letters)}", f"{d(9)}", f"{d(11)}", f"{r.choice('12')} {d(2)} {d(2)} {d(2)} {d(3)} {d(3)}", f"L{d(3)}{r.choice(letters)}{d(4)}"])

    def address(self) -> str:
        r, d = self.r, self.digits
        n = r.randrange(1, 400)
        no = f"{n}{r.choice(['', '', '', '', 'A', 'b', 'c'])}"
        town = r.choice(TOWNS) if r.random() < 0.5 else self.word(1) if r.random() < 0.8 else f"{r.choice(['New', 'Fort', 'Port', 'Saint', 'Lake'])} {self.word(1)}"
        own = r.choice(STREET) if r.random() < 0.35 else self.word(1) if r.random() < 0.7 else f"{r.choice(['Old', 'New', 'North', 'Upper', 'Great'])} {self.word(1)}" if r.random() < 0.35 else f"{self.word(1)} {r.choice(['Hollow', 'Green', 'Bank', 'Hill', 'Park', 'Mill', 'Ferry', 'Lock', 'Farm'])}"
        zip_ = r.choice([d(5), d(5), f"{town[:2].upper()}{r.randrange(1, 30)} {d(1)}{r.choice('ABDE')}{r.choice('LNPR')}"])
        en = f"{no}{r.choice(['', '', '', ','])} {own} {r.choice(ROADS)}" + r.choice(["", f", {town}", f", {town}", f", {town} {zip_}", f", {town}, {zip_}", f", Flat {r.randrange(1, 40)}, {town}", f", Apt. {r.randrange(1, 40)}, {town}"])
        flat = f"Flat {r.randrange(1, 40)}, {no} {own} {r.choice(ROADS)}, {town}"
        if r.random() < 0.2:
            en = en.upper()
        stem = r.choice(DE_STEM) if r.random() < 0.4 else self.word(1)
        road = stem + r.choice(DE_END) if r.random() < 0.8 else r.choice(DE_LONG) if r.random() < 0.6 else f"{r.choice(['Am', 'Im', 'Zum'])} {self.word(1)}{r.choice(['en', 'er', ''])} {r.choice(['Bach', 'Weg', 'Graben', 'Feld'])}"
        de = f"{road} {no}" + r.choice(["", f", {d(5)} {town}", f", {d(5)} {town}", f" in {town}"])
        fname = r.choice(FR_NAME) if r.random() < 0.4 else r.choice(["des ", "du ", "de la ", "de ", ""]) + self.word(1)
        fr = f"{n}{r.choice(['', '', ' bis', ' ter'])}{r.choice(['', ','])} {r.choice(FR_ROAD)} {fname}" + r.choice(["", f", {d(5)} {town}", f" à {town}", f", {d(5)} {town}"])
        ename = r.choice(ES_NAME) if r.random() < 0.4 else r.choice(["de ", "del ", "de la ", ""]) + self.word(1)
        es = f"{r.choice(ES_ROAD)} {ename}{r.choice([',', ''])} {n}" + r.choice(["", f", {r.randrange(1, 9)}º {r.choice('ABCD')}, {d(5)} {town}", f", {d(5)} {town}", f", {town}"])
        return r.choice([en, en, en, flat, de, de, fr, es])

    def plain(self, slot: str) -> str:
        r = self.r
        if slot == "J":
            return " ".join(r.sample(THINGS, r.choice([1, 2, 2])))
        if slot == "R":
            return r.choice(REGISTER)
        if slot == "G":
            return r.choice(TEAMS)
        if slot == "W":
            return r.choice(TOWNS)
        if slot in "uU":
            w = self.word(r.choice([0, 1]))
            return w.lower() if slot == "u" else w
        if slot in "oO":
            w = r.choice(self.words) if r.random() < 0.6 else r.choice(self.words) + r.choice(self.words)
            return w.capitalize() if slot == "O" else w
        if slot == "K":
            w = "".join(r.choice("ABCDEFGHIKLMNOPRSTUVXZ") for _ in range(r.choice([3, 4, 4, 5, 5])))
            return w + r.choice(["", "", "", f"-{self.digits(2)}", f"-{self.digits(2)}{self.letters(3)}-T{self.digits(1)}.{self.digits(2)}"])
        if slot == "H":
            return "".join(r.choice("0123456789abcdef") for _ in range(r.choice([6, 6, 7, 8, 12, 16])))
        if slot == "X":
            return r.choice([f"{self.digits(3)}-{self.digits(2)}-{self.digits(4)}", f"{self.digits(3)}-{self.digits(3)}-{self.digits(4)}", f"{self.digits(4)} {self.digits(4)}", f"{self.digits(9)}"])
        return self.digits(r.randrange(1, 4))

    def fill(self, pattern: str) -> tuple[str, list[tuple[int, int, str]]]:
        out, spans, at = "", [], 0
        while True:
            k = pattern.find("{", at)
            if k < 0:
                return out + pattern[at:], spans
            out += pattern[at:k]
            slot, at = pattern[k + 1], k + 3
            kind = "N" if slot == "T" else slot
            if slot == "T":
                out += self.r.choice(TITLES)
            make = {"N": self.name, "E": self.email, "P": self.phone, "D": self.identity, "A": self.address}.get(kind)
            text = make() if make else self.plain(slot)
            if make:
                spans.append((len(out), len(out) + len(text), kind))
            out += text


def labelled(seed: int = 7, each: int = 22, made: float = 0.6, loose: int = 5000, salad: int = 3500, words: list[str] | None = None) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """The labelled table: (text, [(start, end, kind)]). Most rows have neighbours before or after them, on the same line
    or the next; some are list items, some are shouted, some in lower case.
    words: common words, of which rows without cases are made."""
    f, rows = Filler(seed, made, words), []
    for pattern in SENTENCES:
        for _ in range(each):
            text, spans = f.fill(pattern)
            rows.append((text.lower(), spans) if f.r.random() < 0.06 and len(text.lower()) == len(text) else (text, spans))
    for _ in range(loose):
        rows.append(f.fill(f.loose()))
    rows += [(f.salad(), []) for _ in range(salad)]
    for pattern in PLAIN:
        for _ in range(each if "{X}" in pattern or "{R}" in pattern else each // 2):
            text, _ = f.fill(pattern)
            x = f.r.random()
            if x < 0.08:
                text = text.upper()
            elif x < 0.14:
                text = text.lower()
            elif x < 0.2:  # words split by what is not seen
                text = "".join(c + "​" * (f.r.random() < 0.06) for c in text).replace(" ", " " if x < 0.17 else " ")
            rows.append((text, []))
    f.r.shuffle(rows)
    joined = []
    for row in rows:
        parts = [row]
        if f.r.random() < 0.4:
            parts.insert(0, rows[f.r.randrange(len(rows))])
        if f.r.random() < 0.4:
            parts.append(rows[f.r.randrange(len(rows))])
        text, spans = "", []
        for t, s in parts:
            if text:
                text += f.r.choice([" ", "\n", "\n\n", "\n- "]) if text[-1] in ".:!?" or f.r.random() < 0.15 else "\n"
            elif f.r.random() < 0.1:
                text = "- "
            spans += [(a + len(text), b + len(text), kind) for a, b, kind in s]
            text += t
        joined.append((text, spans))
    return joined
