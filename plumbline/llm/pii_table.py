"""A small labelled table: everyday sentences and forms in three languages, with their personal items marked.

Letters, mails, forms, minutes, notices, reports, contracts and rulings are written with slots. A slot of a personal kind is
filled with an item that is labelled or, at times, with a redacted one that isn't; the other slots are filled with things that
look similar and aren't personal. Names are common ones of many countries or made up of random syllables; numbers follow
the forms of several countries or random groupings. The fillings follow a fixed seed, so the table is the same everywhere.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator

#: {F} full name, {S} surname, {R} surname first, {J} initial and surname, {G} name in small letters, {E} email, {P} telephone, {I} identity
#: number, {A} address; {C} firm, {V} ship, {T} place, {W} street without a number, {N} number of a thing, {D} date, {M} sum,
#: {Q} citation, {K} file number, {H} court or office, {L} statute or doctrine.
ENGLISH = """
{h}: {D}
{h}: {D}
{h}: {M}
{h}: {N}
{h}: {K}
{h} of {D}
{h} {D}
{h}, {D}
{h} at {T}
{h} in {T}, {D}
Hearing: {D}
Date: {D}, time 14:30
Issued: {D}; expires: {D}
Total: {M}; paid: {M}
Ref. {N}
Given on {D}; sent on {D}.
the {n} of {D}
The {n} ({D}) {v} the {n} ({M}).
The {n}, {N}, was {a}.
The {n} number is {N}.
The {n} lasted from {D} to {D} and cost {M}.
The {n} was open until {D}.
The {n} {v} {M} to the {n}.
The {n} of {C} was {v} in {T}.
There was {h}.
{h} was {a}.
So the {n} must fail.
{F} {v} the {n}.
{S} {v} the {n}.
{S} {v} the {n} in {T}.
{S} had {v} the {n}.
Per {S}, the {n} was {a}.
Per {J}: the {n} {v} it.
{J}: the {n} was {a}.
The {n} at {A} was {v}.
{F} resided in {T} and worked at {A}.
{F} stayed at {A} until {D}.
{F} ({P}) {v} the {n}.
Telephone ({P}) or mail ({E})
The caller used {P}.
The line {P} was dead.
Both {P} and {P} were dead.
Notes: {F}, {A}, {D}
tel. {P}. The {n} was {a}.
no. {I}; tel. {P}; {E}
{F}, identity card {I}, {v} the {n}.
{F}, tenant
{F}, landlord
{C}, insurer
Before {R}, magistrate, {F} spoke.
At the inquest {R} gave evidence.
The company was told; {R} was not.
The {n} {v} the {n}.
The {n} {v} the {n}, and the {n} {v} it.
The {a} {n} {v} the {n} on {D}.
The {n} {v} {M} on {D}; the {n} {v} nothing.
On {D} the {n} {v} the {n}.
On {D} the {n} {v} the {a} {n} for {M}.
By {D} the {n} of the {n} was {a}.
Every {n} is {a}; no {n} {v} the {n}.
That {n} was {a}, and the {n} {v} it after {D}.
Given the {a} {n}, the {n} {v} the {n}.
Although the {n} {v} the {n}, the {n} was {a}.
Whether the {n} {v} the {n} is {a}.
{h}
{h} — {h}
{h} — {h} — {h} — {h}
{h}, {h} and {h}
{h}: {h}
{h}. {h}
{C} {v} the {n}, and the {n} {v} {C}.
Invoice no. {N} was {a}.
Bill no. {N} and order no. {N} were {v}.
Company register {N}
{C} (registered under {N}) {v} the {n}.
{C} (trade register no. {N}) was {a}.
The policy ({N}) was {a}.
The invoice ({N}) and the contract ({N}) were {a}.
Exhibit {N} shows that the {n} {v} the {n}.
Exhibit {N} proves the {n}.
Lot {N} on the map is {a}.
Claim {N}, file {N}
The vessel {V} was {v} on {D}.
The vessel {V} {v} the {n}.
The yacht {V} was {v} in {T}.
The ship {V} was {v} on {D}.
The motor vessel {V} and the {n} were {a}.
The barge {V} and her {n} were {v} for {M}.
A boat named {V} was {v}.
The work in {W} was {v} on {D}.
The {n} near {W} was {a}.
As {Q} shows, the {n} is {a}.
In {Q} the {n} {v} the {n}.
The {n} rests on {Q} and {Q}.
{Q}; {Q}; {Q}
Under the {L} the {n} is {a}.
By the {L}, the {n} {v} the {n}.
The {n} fails under the {L}.
For the {n}, counsel said that the {n} was {a}.
Dear {F},
Dear Mr {S},
Dear Ms {S} and Mr {S},
Yours sincerely, {F}
Kind regards, {F}
Best wishes, {J}
Signed: {F}
Signed by {F} on {D} in {T}.
Prepared by {J}, checked by {J}.
From: {F} <{E}>
To: {E}
Cc: {E}, {E}
Reply to {E} please.
You can reach {F} on {P} or at {E}.
Call me on {P} after six.
Phone: {P}
Tel. {P}, fax {P}
Mobile {P}, home {P}
Ring {P} and ask for {F}.
The number {P} was busy all morning.
Two calls came from {P}; nobody answered when {P} was tried.
{P} is {F}'s new number.
His number is {P}, hers is {P}.
Email: {E}
E-mail address: {E}; alternative: {E}
My address is {E}, spelled out so that robots don't find it.
Write to {E} for the minutes.
Mail bounced from {E} twice.
<{E}> unsubscribed yesterday.
Click mailto:{E} to answer.
Name: {F}
Name: {R}
name: {G}, phone {P}
Surname: {S}
First witness: {F}
Applicant: {F}, {A}
Patient: {R}, no. {I}
Holder {F}, passport no. {I}
Address: {A}
Home address: {A}
Deliver to {F}, {A}.
Please send everything to {A}.
We moved from {A} to {A} last spring.
The house at {A} was sold to {F} for {M}.
{F} lives at {A}.
{F}, of {A}, was born in {T}.
She has rented {A} since {D}.
An ambulance was called to {A} at night.
The van was parked in front of {A}.
{A} belongs to the estate of {F}.
{A} stood empty when the post came.
Letters went to {A}, where {S} had once lived.
My SSN is {I}.
Social security number: {I}
National insurance no. {I}
Her tax number, {I}, was missing on the return.
ID {I}, valid until {D}
The identity card {I} had expired.
Passport {I} was reported stolen by {F}.
His driving licence ({I}) names another town.
{I} is the tax number of {F}.
{F} (NHS number {I}) was admitted on {D}.
{F} ({I}) joined on {D}.
Employee {F}, {I}, salary {M}.
Registered: {F}, {I}, {P}.
The card shows {F} and the number {I}.
Member no. {I}; phone {P}; {E}.
Contact: {F}, {P}
Contact: {F}, {A}, {P}, {E}
Emergency contact {F} (mother), {P}.
Guests: {F}, {F}, {F} and {F}.
Present: {F}, {F}; absent: {F}.
Minutes taken by {F}.
Chair: {F}
{F} (chair), {F} (treasurer), {F}
{F} and {F} were married in {T}.
{F} has left the company.
{F} said nothing for a while.
{F}, who had come by train, agreed with {S}.
{F} told the reporter that {C} had no plans.
{S} won.
{S} refused.
{S} has retired.
{S} agreed; {S} did not.
{S} replied that the weather was to blame.
{S} and {S} shook hands.
{S}'s car was found in {T}.
{S}’s answer came by post.
That was {S}'s idea.
It was {S} who called first.
Neither {F} nor {S} knew of it.
Neither {S} nor {S} came back.
Both {S} and {S} deny it.
According to {S}, the bridge was closed.
In the words of {J}, it never happened.
A note from {J}, dated {D}, was lost.
We trust what {J} told us.
As {J} put it: no.
{J} signed for the parcel.
Mr {S} laughed; Mrs {S} didn't.
Mrs {S} forgot, and Mr {S} never knew.
Dr {S} examined the child.
Professor {F} teaches at the university.
Officer {S} stopped the bus near {W}.
Police are looking for {R}, last seen in {T}.
On the list: {R}; {R}; {R}.
Then {R} spoke for an hour.
Without a lawyer, {R} spoke for herself.
In the end {R} was elected.
I met {F} in {T} on {D}.
My brother {F} and my aunt {F} own the shop.
The driver, {F}, was not hurt.
The author ({F}) thanks {F} for reading a draft.
The buyer ({S}) paid {M}; the seller ({S}) kept the keys.
The lease was made out to {F} on {D}.
A cheque for {M} went to {F}.
Transfer {M} to {F}, account {N}.
{F} v {F}
{F} v. {C}
{C} v. {F}
{S} v. {S}
{S} v. {C}
{C} v. {S}
{S} v. {S} ({K})
{S} v. {C} ({K})
{C} v. {S} ({K})
{K}: {S} v. {S}, page 4
Page 7 / {K} / {S} v. {C}
{F} (Claimant) v. {F} (Defendant)
{F} (Claimant) v. {C} (Defendant)
{C} (Plaintiff) v. {F} (Defendant)
Judge: {F}
Judges: {F}, {F} (president), {F}
Before {F} and {F}, judges
Counsel: {F} for the plaintiff, {F} for the bank
Heard by {F} on {D}
{F}, plaintiff
{F}, defendant
{C}, plaintiff
{C}, defendant
{F}
{C}
against
and
versus
The plaintiff {F} asked for {M}.
The defence witness {F} was believed; {F} was not.
Evidence was heard from {F} and from {F}.
The prisoner, {F}, may appeal.
The sister of {F} inherited everything from {F}.
A will named {F} as heir.
Cross-examined, {F} stuck to the story.
Attorney {F} withdrew.
{H}
{H}, {K}
{H}, {D}
Ruling of {D}
File {K}
Docket {K}
Re: {K}
Your reference: {K}; our reference: {K}
Order of {D}, {K}
The motion is denied.
The claim fails and must be dismissed with costs.
Costs of {M} are awarded.
The bench rose at noon.
Reasons follow.
Summary of the facts
Notes
Conclusions and orders
Late filing, missing signatures and unpaid fees were discussed.
Delay — prejudice — remedy.
Contract — breach — measure of damages.
Bad faith — duty of care — time limits.
Unfair process was alleged, as was an unclear contract.
Under section 12 of the {L} a permit is needed.
Section 9 of {L} is silent on deposits.
The {L} doesn't help here.
The {L} applies to tenants too.
Read with the {L}, the rule is clear.
On the {L} we follow {Q}.
Compare {Q} and {Q}.
See {Q}, at page 12.
{Q} was decided differently.
The rule in {Q} is well known.
That is the effect of {Q} and of {Q} [31].
We follow {Q}, although the tenant argued otherwise.
The schooner {V} sank off {T}.
The ferry {V} leaves {T} at eight.
The ship {V} and her load were auctioned for {M}.
A vessel, the {V}, lay in port for 12 days.
The trawler {V} was seized in {D}.
The yacht {V} lost her mast.
Aboard the {V} there was no doctor.
The tanker {V}, built for {C}, was late.
{C} makes windows in {T}.
{C} sold {C} for {M}.
{C} owns the warehouse and the ship.
{C} denied any fault before the owner did.
Shares in {C} rose.
{C} and {C} merged on {D}.
{C} (company no. {N}) is in liquidation.
The supplier, {C}, was two weeks late.
According to {C}, entered in the trade register under {N}, nothing is owed.
Invoice {N} from {C} is due.
Invoice number {N}, order number {N}
Bill {N} was settled late.
Order {N} left the depot on {D}.
Policy {N} covers {C} alone.
The insurance policy ({N}) lapsed.
Case no. {N}
Plot {N} borders {W} on one side and {W} on the other.
Parcel {N} lies behind {W}.
Exhibit {N} is a photograph of the wall.
Exhibit {N}: a list of the keys.
Annex {N} shows the drain.
Contract {N} was never found.
Tracking number {N}
Ticket {N} was closed.
Account {N}, balance {M}
Serial number {N}
Licence plate {N}
Part no. {N}, batch {N}
Room {N} was empty.
Company register: {N}
Follow us at {N} for news.
Roadworks near {W} end on {D}.
The fire in {W} was out by noon.
Trees along {W} were cut.
The shop in {W} is closed.
Between {W} and {W} the road is narrow.
{W} is closed to traffic.
The bus stops at {W}.
It rained in {T} for 14 days.
From {T} to {T} it takes an hour.
{T} is a small town near {T}.
The market in {T} opens at nine.
Done at {T}, {D}
Done in {T} on {D}.
He left {T} and never saw {T} again.
{D}
{D}, {T}
The meeting of {D} was moved to {D}.
The price is {M}, of which {M} is tax.
It cost {M} in {D}.
A deposit of {M} was returned.
Payment of {M} is due by {D}.
Nothing in the lease, the letter or the survey says so.
The tenant repaired the roof, although the landlord had not asked.
The seller kept the deposit; the buyer kept the keys.
The expert found no fault with the drains.
The insurer, the owner and the bank settled.
The registrar returned the form because the fee was missing.
The agency refused the permit, and no reason was given.
On {D} the landlord withdrew the offer.
On {D} the insurer agreed to pay {M}.
Whether the notice was late is plain enough.
Whether the point matters is doubtful, and the expert said so.
It is unusual that the guarantee was never signed.
There is no dispute about the boundary.
This ground of appeal is without merit.
Permission to appeal was refused by the first judge.
Nobody challenged the finding, which rests on the documents.
Everyone agreed that the loan had been repaid before {D}.
Several questions remain open.
Further terms apply.
Thank you for your letter of {D}.
Please find attached the report.
Minutes of the annual meeting
Agenda item 3: roof repairs
Terms and Conditions
(translated)
(signature)
[stamp]
Not for publication.
Sheet 3 of 12
- 14 -
"""

GERMAN = """
{x}: {D}
{x}: {M}
{x} vom {D}
{x} Nr. {N}
{H}
Az. {K}
Richterin {F}
Richter {F}
{F}, Kläger, und {C}, Beklagte
{F}, Kläger, gegen {F}, Beklagter
{F}, Mieterin
Die {x} ging an {A}.
Anschrift: {A}. Die {x} ist {w}.
Der Anruf kam von {P}.
Zeuge {F} hat die {x} {y}.
Die Zeugin {F} wurde am {D} gehört.
{F} wohnte in der {A} und zahlte {M}.
Die {x} ging an {E}.
Der {w} {x} hat die {x} {y}.
Die {x} hat den {x} {y}.
Das {x} hat die {x} nicht {y}.
Am {D} hat der {x} die {x} {y}.
Die {x} vom {D} ist {w}.
{x}
{x} — {x}
{x} — {w} {x} — {x}
{w} {x} — {w} {x}
Eine {w} {x} wurde {y}.
Ob die {x} {w} ist, hat das {x} {y}.
Die {C} hat das {x} {y}.
Die {C} hat die {x} {y} (Beleg {N}).
{x} bleibt {M}.
Maßgebend ist § 40; die {x} wurde {y}.
Nach {Q} ist die {x} {w}.
Auf {Q} kommt es für die {x} an.
Sehr geehrter Herr {S},
Sehr geehrte Frau {S},
Mit freundlichen Grüßen {F}
Name: {F}
Name, Vorname: {R}
Anschrift: {A}
Wohnhaft in der {A}
Telefon: {P}
Tel. {P}
Handy {P}, abends {P}
Rückruf bitte unter {P}.
Unter {P} meldete sich niemand.
{P} ist die Nummer von {F}.
E-Mail: {E}
Schreiben Sie an {E}.
Die Mahnung wurde an {E} geschickt.
Ansprechpartner: {F}, {P}, {E}
Kontakt: {F}, {A}, Tel. {P}, {E}
Kontakt: {F}, {A}, {P}, mailto:{E}
Das Paket ging an {A}.
Der Brief kam aus {A} zurück.
{F} wohnt seit {D} in der {A}.
{F} zog am {D} in die {A}.
Er ist in der {A} gemeldet.
Steuernummer {I}
Ausweis Nr. {I}
Die Sozialversicherungsnummer lautet {I}.
{F}, Ausweis {I}, ist Mieter.
{F} (Personalnummer {I}) kündigte.
Herr {S} lachte.
Herr {S} kam zu spät, Frau {S} gar nicht.
Frau {S} weiß davon nichts.
{S} schwieg.
Nach Aussage von {S} war die Tür offen.
Laut {S} war alles bezahlt.
Die Nachbarin {F} hat den Lärm gehört.
Der Fahrer {F} blieb unverletzt.
Als Zeuge wurde {F} gehört.
Vorsitzende: {F}
Vorsitzender Richter {F}
Richterin am Amtsgericht {S}
Rechtsanwalt {F}
{F}, Klägerin
{F}, Kläger
{F}, Beklagter
{C}, Beklagte
{C}, Klägerin
wegen Forderung
gegen
Im Namen des Volkes
In dem Rechtsstreit
{H}
{H}, {K}
Aktenzeichen {K}
Beschluss vom {D}
Urteil des Senats
Tenor
Gründe
Die Klage wird abgewiesen.
Die Parteien streiten um {M}.
Es verbleiben {M} und die Zinsen.
Der Streitwert wird auf {M} festgesetzt.
Der Kläger trägt die Kosten.
Die Beschwerde hat keinen Erfolg.
Der Senat folgt dem Landgericht.
Das Amtsgericht hat den Antrag nicht geprüft.
Die Behörde hat den Antrag abgelehnt.
Der Vermieter hat die Wohnung nicht geräumt.
Das Gutachten war unvollständig, der Sachverständige wurde gehört.
Die Versicherung verweigerte die Zahlung.
Am {D} wurde der Vertrag gekündigt.
Am {D} hat die Mieterin das Haus verlassen.
Fehlende Unterschrift — verspätete Klage — Zinsen.
Mangel — Frist — Beweis.
Maßgebend ist § 12 BGB, das {L} gilt nicht.
Nach § 40 des {L} ist eine Genehmigung nötig.
Die {L} bleibt unberührt.
So auch {Q}, Rn. 12.
Vergleiche {Q}.
Anders {Q}, jedoch ohne Begründung.
Die {C} lieferte nicht (Beleg {N}).
{C} liefert am {D}.
Rechnung Nr. {N} der {C}
Kundennummer {N}, Auftrag {N}
Anlage {N} enthält den Plan.
Das Grundstück {N} liegt an der {W}.
Das Schiff {V} lag in {T}.
Die Fähre {V} fährt nach {T}.
{T}, den {D}
Von {T} nach {T} fährt kein Zug.
Die Sitzung vom {D} fällt aus.
Der Preis beträgt {M}.
Die Frage ist üblich, aber nicht entscheidend.
Vielen Dank für Ihr Schreiben vom {D}.
"""

FRENCH = """
{m} : {D}
{m} : {M}
{m} du {D}
Président : {F}
Président: {F}
Juge: {F}
{F}, locataire,
{F}, demandeur, et {F}, défendeur
et {C}, assureur
entre {F}, appelant, et {C}, intimé
L'appel venait du {P}.
Le témoin {F} a {u} le {m}.
La {m} a été envoyée à {E}.
L'huissier est allé {A}.
{F} demeure {A} depuis le {D}.
{F}, carte n° {I}, a {u} le {m}.
M. {S} a {u} le {m}; Mme {S} l'a {u}.
Il n'est pas {o} que la {m} soit {o}.
Il y a {m}.
Le {m} a {u} le {m}.
La {m} n'a pas {u} l'{m}.
L'{m} a {u} la {m} le {D}.
Le {D}, le {m} a {u} la {m}.
{m}
{m} — {m}
{m} {o} — l'{m} — la {m}
Une {m} {o} — un {m} {o}
Un {m} {o} — le {m} — la {m}
Il est {o} que la {m} ait {u} le {m}.
La société {C} a {u} le {m} (annexe {N}).
La {m} de {M} est {o}.
Les {m}s sont de {M}.
Selon {Q}, la {m} est {o}.
Aux fins de l'article 12, le {L} est {o}.
Cher Monsieur {S},
Chère Madame {S},
Cordialement, {F}
Nom : {F}
Nom et prénom : {R}
Adresse : {A}
Domicilié {A}
Tél. : {P}
Téléphone {P}
Portable {P}, bureau {P}
On peut joindre {F} au {P}.
Le {P} ne répond pas.
Courriel : {E}
Écrivez à {E} avant le {D}.
Le message a été envoyé à {E} hier.
Contact : {F}, {A}, tél. {P}, {E}
Contact : {F}, {A}, {P}, <{E}>
Le colis est parti pour {A}.
Le facteur est passé {A}.
{F} habite {A}.
{F} a vécu {A} jusqu'en {D}.
{F} loue {A} depuis le {D}.
Numéro fiscal {I}
Carte d'identité n° {I}
Sécurité sociale : {I}
{F}, passeport {I}, est absent.
{F} (matricule {I}) a démissionné.
M. {S} a souri.
M. {S} est parti; Mme {S} est restée.
Mme {S} n'en sait rien.
{S} se tait.
D'après {S}, la porte était ouverte.
Pour {S}, tout est payé.
La voisine {F} a tout vu.
Le conducteur, {F}, est indemne.
On a entendu {F} comme témoin.
Juge : {F}
Présidente : {F}
Maître {F}, avocat
{F}, demandeur
{F}, défenderesse
{C}, défenderesse
Affaire {S} contre {C}
contre {F}
Entre : {F}
et : {C}
{H}
{H}, {K}
Dossier {K}
N° {K}
Décision du {D}
Faits et procédure
Motifs
Dispositif
La demande est rejetée.
Les frais s'élèvent à {M}.
Il reste à payer {M}.
Le bailleur a repris le logement.
L'assureur refuse de payer.
L'expert n'a pas rendu son rapport.
La préfecture a refusé le permis.
Le premier juge a commis une erreur.
Le {D}, la locataire a quitté la maison.
Retard — faute — preuve.
Défaut de signature — délai — intérêts.
En vertu de l'article 12 du {L}, le délai court.
La {L} ne s'applique pas.
Voir {Q}.
Comparer {Q}, n° 12.
La société {C} a livré la marchandise (annexe {N}).
{C} vend des bateaux à {T}.
Facture n° {N} de {C}
Commande {N}, client {N}
Le navire {V} est resté à {T}.
Le terrain {N} donne sur la {W}.
Fait à {T}, le {D}
De {T} à {T} il n'y a pas de train.
Le prix est de {M}.
La question est constante et sans intérêt.
Merci pour votre lettre du {D}.
"""

NOUNS = "notice lease contract court claim fee tax roof wall garden harbour cargo ship bank loan sale price buyer seller tenant landlord owner insurer agent carrier driver witness expert judge registrar clerk council board union employer worker patient doctor teacher school hospital police officer report letter form receipt permit licence survey plan map fence drain well road bridge field farm estate will trust gift share profit loss damage injury delay breach duty care risk fault proof evidence finding error reason remedy appeal order ruling costs interest deposit rent repair defect warranty goods delivery invoice payment debt mortgage guarantee partner company director audit budget deed charter pension wage bonus dismissal hearing trial motion consent signature translation valuation inspection inventory tender offer auction limitation jurisdiction service procedure burden bias omission mistake objection refusal silence transfer assignment possession ownership negligence nuisance trespass fraud forgery capacity confusion publication conversion".split()
ADJECTIVES = "late early common plain clear unclear doubtful certain material immaterial useful useless fair unfair written oral missing broken new old final interim partial decisive technical unusual ordinary settled open valid void apparent defective excessive sufficient unsatisfactory relevant harmless urgent strict".split()
VERBS = "accepted refused disputed overlooked construed produced withdrew signed paid returned examined rejected misunderstood reviewed mentioned delayed sold bought seized arrested inspected cancelled renewed answered ignored confirmed denied described measured repaired stopped published attached contested approved submitted quoted".split()
GERMAN_PARTS = "Bau Miet Kauf Straf Sach Rechts Steuer Zeit Haus Grund Land Wasser Schul Arbeits Verkehrs Versicherungs Zahlungs Liefer Beweis Verfahrens Urkunden Vertrags Gutachten Hafen Grenz Form Begründungs Kündigungs Verjährungs Zustellungs Zuständigkeits Zustimmungs".split()
GERMAN_ENDS = "vertrag genehmigung ordnung frist schaden mittel verfahren beweis recht pflicht mangel fehler gesetz würdigung stellung rechnung kosten zeit verlauf führung entscheidung beschwerde gericht behörde akte antrag bescheid urteil zahlung prüfung".split()
GERMAN_WORDS = "Berufung Revision Klage Klägerin Kläger Beklagte Beklagter Behörde Versicherung Verjährung Zustellung Zuständigkeit Zustimmung Kündigung Darlehen Gutachten Bescheid Sachverständige Vermieter Mieterin Landgericht Leitsatz Leitsätze Sommaire Anlage Zinsen Streitwert Parteien Gründe Senat Kammer Beschwerde Antrag Vollmacht Bürgschaft Eigentum Besitz Schaden Unterschrift".split()
GERMAN_VERBS = "geprüft abgelehnt bestritten anerkannt vorgelegt missverstanden zurückgewiesen berücksichtigt geändert gekündigt bezahlt verlangt übersehen begründet erhoben unterschrieben angenommen".split()
GERMAN_ADJECTIVES = "verspäteter verspätete fehlende fehlender unrichtiger unrichtige unklar unerheblich üblich gesichert streitig entscheidend wirksam mangelhafte rechtzeitige schriftliche offen eines keine weitere".split()
FRENCH_NOUNS = "bail prêt facture permis mur lettre rapport expert assureur bailleur locataire appelante intimé huissier administration juge tribunal cour demande délai signification prescription incompétence motivation erreur calcul vice forme défaut accord absence moyen grief somme dépens frais jugement article règlement preuve faute dommage vente acte témoin tardiveté recours dossier sommaire motif préjudice contrat signature".split()
FRENCH_VERBS = "rejeté contesté examiné produit accepté négligé écarté signé payé reçu confirmé retiré soutenu modifié livré annulé".split()
FRENCH_ADJECTIVES = "constant douteux décisif technique habituel établi tardif écrit nul valable formel incertain utile manifeste légal".split()

#: Lines of court and office papers, put together from lists of words: {role} of a party, {head} of a passage, {thing} with a number, {paper} of a
#: person with a number, {line} of a telephone, {stay} at an address, {act} of a person.
PAPERS = """
{F}, {role}
{F}, {role},
{C}, {role}
{C}, {role},
{F}, {role}, and {F}, {role}
{F}, {role}, and {C}, {role}
{F}, {role}; {C}, {role}
{C}, {role}; {F}, {role}
and {F}, {role}
and {C}, {role}
et {F}, {role}
et {C}, {role}
gegen {F}, {role}
gegen {C}, {role}
{F} ({role})
{C} ({role})
{F} ({role}) v. {F} ({role})
{F} ({role}) v. {C} ({role})
{C} ({role}) v. {F} ({role})
{role}: {F}
{role}: {C}
{role} {F}
{F} - {role}
{role} {F} and {role} {F}
The {role}, {F}, {act}.
The {role} ({F}) {act}.
The {role} {act}.
The {role}'s {n} was {a}.
{head}
{head}
{head}
{head}: {F}
{head}: {F} and {F}
{head}: {F}, {F}
{head}: {F} ({role}), {F}
{head}: {role} {F}, {role} {F}
{head}: {D}
{head} of {D}
{head} {D}
{head} — {h}
{F} {head} {D}
{F}, {F} {head} {D}
{K} {F}
{K} {C}
{H} {K} {F}
{head} {K} {F}
{head} {F}, {role}
{head} {C}, {role}
{thing} {N}
{thing} {N} {act}.
{thing} ({N}) {act}.
{thing} no. {N} {v} the {n}.
{thing} no. {N} was {v}.
{thing} {N}: {h}
{C} ({thing} {N}) {act}.
{C} {act} ({thing} {N}).
the {thing} ({N}) of {C}
a {thing}, {N}, was {v}
{thing} {N} of {D} and {thing} {N}
{paper} {I}
{paper}: {I}
{paper} no. {I}
{paper} ({I}) {act}.
The {paper} ({I}) was {v}.
the {paper} {I} of {F}
{F}, {paper} {I}
{F}, {paper} {I}, {act}.
{F} ({paper} {I}) {act}.
{I} is a {paper}.
Her {paper} is {I}; his is {I}.
{line} {P}
{line}: {P}
{line}: {P}. {line}: {P}.
{line} ({P})
{P} ({line})
the {line} {P} was {a}
{F}, {line} {P}, {act}.
{F} ({P})
{F} {act} ({P}).
From the {line} {P} someone {act}.
{P} is a {line}; {P} isn't.
{P} or {P}
{P} and {P} were tried.
{P}
{F} {stay} {A}.
{F} {stay} {A} until {D}.
{S} {stay} {A}, and {S} {act}.
The {role} {stay} {A} on {D}.
The {n} {stay} {A}.
{stay} {A}, {F} {act}.
{A}
{A}, {D}
{A} was {v} on {D}.
{A} is {a}.
{J}, {A}
{F}, {A}, {P}
{F}, {A}, {line} {P}, {E}
The {role} {stay} {W}.
The {n} at {W} was {v}.
from {W} to {W}
{W} and {W} were {v}.
{W} or {W}
{S} {act}.
{S} {act}; {S} {act}.
{S} and {S} {act}.
{F} {act}.
{F} and {F} {act}.
{F} {act} on {D}.
{R} {act}.
The {role} was {R}.
In {T}, {R} {act}.
{J} {act}.
Then {S} {act}.
When {S} {act}, {F} {act}.
{n} by {S}
{n} of {F}
{n} to {S}
{n} to {F} at {T}
It was {v} by {F}.
{v} by {S} at {T}
{S}'s {n} {v} the {n}.
{S}’s {n} was {a}.
Mr {S} {act}, Ms {S} {act}.
Herr {S} {act}, Frau {S} {act}.
M. {S} {act}; Mme {S} {act}.
{E}
{line}: {E}
<{E}>
{E} {act}.
{F} {act} from {E}.
{head} {H}
{H} {head} {D}
{n} of the {L}
{head} {L}
the {V} and the {n}
the {n} {V}
the ship {V}
{open} {n} {v} the {n}.
{open}, the {n} was {a}.
{open} the {n} {v} {M}.
{offen} ist die {x} vom {D}.
{offen} bleibt, ob der {x} {w} war.
{offen} hat das {x} die {x} {y}.
{offen} sind {M}.
{offen} wurde {x}.
{head}
{offen}, {x}: {F}
Postal address {A}
{x} {A}
{x}: {A}
unter {A}
in der {A}
{S}, {F} and {R} {act}.
The {role} heard {R}.
Through an interpreter, {R} {act}.
Later that day, {R} {act}.
With some hesitation, {R} {act}.
{n} from {W} to {W}
the {n} in {W} and in {W}
the {n} of {W} and {W} on {D}
{n} near {W} and {W}
{W}, {W} and {W}
"""
OPENERS = "However Therefore Moreover Nevertheless Still Here There Then Thus Next First Second Finally Later Earlier Meanwhile Again Also Perhaps Clearly Indeed Instead Nothing Something Neither Either Both Some Many Most Several Another Such This That These Those Every Any No One Two Three What Where When While Since Until Because Unless Applying Considering Following Regarding Contrast Compare Further Insofar Absent Otherwise".split()
OPENERS_GERMAN = "Streitig Unstreitig Offen Unklar Maßgebend Maßgeblich Entscheidend Insoweit Insofern Allerdings Jedoch Zudem Ferner Hiernach Danach Demnach Somit Folglich Zugestellt Geprüft Erforderlich Unerheblich Möglich Richtig Falsch Zutreffend Dagegen Dabei Dazu Damit Dennoch Hierzu Ebenso Zunächst Schließlich Zuletzt Bereits Vorliegend Kontakt Betreff Antwort Absender Empfänger".split()
ROLES = "appellant respondent claimant plaintiff defendant applicant petitioner intervener complainant accused witness expert judge magistrate registrar counsel clerk bailiff chair president landlord tenant insurer owner buyer seller debtor creditor trustee executor Appellant Respondent Claimant Applicant Judge President presiding Justice Kläger Klägerin Beklagte Beklagter Antragsteller Berufungskläger Zeuge Zeugin Richter Richterin Vorsitzende Gutachter appelant appelante intimé intimée demandeur demanderesse défendeur défenderesse requérant témoin juge Président Présidente greffier".split()
HEADINGS = "Between|BETWEEN|Before|BEFORE|Coram|CORAM|Panel|Judges|JUDGES|Judge|Hearing|HEARING|Heard|Judgment|JUDGMENT|Decided|Decision|DECISION|Ruling|Order|ORDER|Opinion|Reasons|REASONS|Facts|FACTS|Summary|SUMMARY|Headnote|HEADNOTE|Headnotes|Keywords|Held|Background|Costs|Disposition|Appeal|Signed|Parties|Present|Case|File|Urteil|URTEIL|Beschluss|Tatbestand|Gründe|Tenor|Leitsatz|LEITSATZ|Leitsätze|Streitsache|Verhandlung|Arrêt|ARRÊT|Jugement|Sommaire|SOMMAIRE|Motifs|Dispositif|Faits|Audience|Composition".split("|")
THINGS = "invoice|order|policy|lot|plot|exhibit|annex|company register|trade register|contract|claim|ticket|parcel|docket|account|receipt|batch|item|serial|meter|reference|permit|warrant|Invoice|Order|Policy|Lot|Exhibit|Annex|Claim|Company no.|Bill|Docket|Anlage|Rechnung|Police|Auftrag|Beleg|Handelsregister|Flurstück|pièce|facture|police|commande|annexe|lot|dossier|registre".split("|")
PERSONAL_PAPERS = "passport|identity card|ID card|identity number|tax number|social security number|social insurance number|national insurance number|driving licence|residence permit|health insurance number|personal number|Ausweis|Reisepass|Ausweisnummer|Steuernummer|Sozialversicherungsnummer|passeport|carte d'identité|numéro fiscal|numéro de sécurité sociale|permis de séjour".split("|")
LINES = "phone|telephone|tel.|Tel.|Phone|Telephone|mobile|Mobile|cell|Cell|fax|Fax|office|Office|home|Home|line|number|call|caller|hotline|switchboard|Telefon|Handy|Anschluss|Mobil|Büro|tél.|Tél.|téléphone|portable|bureau|Fixe".split("|")
STAYS = "lives at|lived at|resides at|resided at|stays at|works at|moved to|moved from|was seen at|was born at|died at|called at|knocked at|waited at|went to|drove to|visited|attended|searched|rented|let|sold|bought|owns|left|was found outside|stood behind|stood near|stopped at|was delivered to|was served at|was addressed to|is registered at|wohnt in der|wohnte in der|zog in die|liegt in der|habite|habitait|demeure|s'est rendu|est situé".split("|")
ACTS = "agreed|disagreed|objected|appealed|appeared|testified|denied it|said so|said nothing|remembered nothing|did not recall it|did not|has not replied|was absent|was heard|paid|refused|signed|left|returned|wrote back|called again|was believed|lost|won|conceded the point|kept quiet|resigned|retired|came late|gave the name away|wrote to the bank|hat es bestritten|schwieg|kam nicht|hat unterschrieben|erschien|a signé|a refusé|ne dit rien|est venu|conteste tout".split("|")

#: Forms and heads, whose lines stand together.
FORMS = [
    "{F}\n{A}\n{P}\n{E}\n\n{T}, {D}\n\nDear Mr {S},",
    "{C}\n{W}, {T}\n\n{F}\n{A}\n\nInvoice {N}\nAmount: {M}",
    "From: {E}\nTo: {E}\nDate: {D}\nSubject: Order {N}\n\nHi {F},",
    "Name: {F}\nBorn: {D}\nID: {I}\nPhone: {P}\nAddress: {A}",
    "Police report {K}\nReporting officer: {F}\nPlace: {W}, {T}\nDriver: {R}\nLicence: {I}",
    "Minutes of {D}\nPresent: {F}, {F}, {F}\nAbsent: {F}\n1. Roof\n{S} reported.",
    "{H}\n{K}\n\n{F}, plaintiff\nagainst\n{C}, defendant\n\nJudge {F}\n{D}\n\nReasons",
    "{H}\nFile {K}\n\n{C}\nversus\n{F}\n\nPresiding: {F}; {F}\nHeard on {D}",
    "THE {H}\nNo. {K}\n{F}\n   versus\n{F}\nJudge {F}\nDated {D}",
    "{H} / {K}\n{F} (Claimant) v. {C} (Defendant)\nJudge {F}, Judge {F}\n{D}\n\nSummary of the facts\nDelay — remedy.",
    "{H}\n{K}\nUrteil des Senats\nin dem Rechtsstreit\n{F}, Klägerin,\ngegen\n{C}, Beklagte,\nRichter {F}\n{D}",
    "{H}\n{K}\nBeschluss vom {D}\n{F}, Kläger,\ngegen\n{F}, Beklagte,\nVorsitzende Richterin {F}\n\nMangel — Frist.",
    "{H}\nDossier {K}\nDécision du {D}\nentre {F}, demandeur,\net {F}, défendeur\nJuge : {F}\n\nMotifs\nRetard — faute.",
    "{H}\n{K}\nentre {C}, demanderesse,\net {F}, défendeur\nPrésidente : {F}",
    "Several questions remain open.\n{H}      {K}      4\nReasons follow.",
    "The motion is denied.\nPage 7 — {K} — {S} v. {C}\nNobody challenged the finding.",
    "The tenant paid.\n\nPage 2 — {K} — {S} v. {S}\n\n8 The insurer did not.",
    "The bench rose at noon.\n{S} v. {S} ({K})\nCompare {Q} and {Q}.",
    "Nothing is owed.\n{C} v. {S}, {K}\n9\nThe expert found no fault.",
]

PERSONAL = {"F": "name", "S": "name", "R": "name", "J": "name", "G": "name", "E": "email", "P": "phone", "I": "idnum", "A": "address"}
GIVEN = "James Mary John Linda Robert Susan Michael Karen David Helen Thomas Ruth Peter Alice George Emma Edward Grace Henry Rose Oliver Amy Jack Diane Samuel Julia Hans Petra Klaus Ursula Jürgen Monika Stefan Sabine Uwe Heike Lukas Anke Pierre Marie Jean Claire Luc Chloé Michel Élodie René Sylvie Giulia Marco Paolo Lucia Carlos Ana José Carmen Ivan Olga Piotr Agnieszka Jan Zofia Lars Ingrid Björn Astrid Mehmet Ayşe Ahmed Fatima Omar Layla Wei Mei Hiroshi Yuki Raj Priya Nguyen Linh Kwame Amina Jane".split()
FAMILY = "Smith Jones Taylor Brown Williams Wilson Johnson Davies Robinson Wright Thompson Evans Walker White Roberts Green Hall Wood Clarke Hughes Edwards Hill Moore Lane Cooper Ward Turner Street Baker Carter Müller Schmidt Schneider Fischer Weber Meyer Wagner Becker Schulz Hoffmann Koch Richter Klein Wolf Schröder Neumann Braun Zimmermann Krüger Martin Bernard Dubois Petit Durand Leroy Moreau Lefèvre Girard Rousseau Rossi Ferrari Bianchi Romano García Fernández López Silva Santos Ivanov Petrov Novák Kowalski Wójcik Hansen Nielsen Andersson Lindqvist Yılmaz Demir Khan Hussein Haddad Chen Wang Tanaka Sato Patel Sharma Tran Okafor Mensah Doe Parker Bridges".split()
TOWNS = "London Leeds York Bristol Dublin Boston Denver Austin Berlin Hamburg Köln Leipzig Bremen Graz Zürich Basel Paris Lyon Nantes Lille Bruxelles Genève Oslo Malmö Turin Porto Kraków Brno".split()
FIRMS = ["Ltd", "Limited", "plc", "Inc.", "Corp.", "LLC", "GmbH", "AG", "KG", "S.A.", "SARL", "SAS", "S.p.A.", "BV", "& Sons", "& Co", "& Co. KG", "&amp; Co", "Holdings", "Group", "Bank", "Insurance", "Insurance Ltd", "Shipping", "Shipping Co", "Works", "Logistics", "Logistics GmbH", "Estates", "Estates plc", "Foods", "Partners", "Lending", "Trading Inc.", "Industries", "Motors", "Capital", "Energy AG", "Brothers Ltd"]
BODIES = ["Port Authority", "Ministry of Transport", "City Council", "Revenue Service", "Board of Trade", "Land Office", "Railway Board", "Harbour Trust", "Housing Registry", "Health Board", "Stadt {}", "Commune de {}", "Borough of {}"]
COURTS = ["County Court of {}", "Crown Court at {}", "{} Magistrates", "Supreme Court of {}", "High Court of {}", "Court of Appeal, {}", "{} District Court", "Land Court of {}", "Labour Court, {}", "{} Employment Tribunal", "{} Maritime Board", "Tribunal of {}", "Amtsgericht {}", "Landgericht {}", "Oberlandesgericht {}", "Verwaltungsgericht {}", "Arbeitsgericht {}", "Bundesgericht {}", "Tribunal de {}", "Tribunal judiciaire de {}", "Tribunal administratif de {}", "Cour d'appel de {}", "Cour de cassation"]
LAWS = ["{} Act", "{} Act 1987", "{} Code", "{} doctrine", "{} test", "{} rule", "{} Convention", "{} Ordinance", "Rules of Evidence", "Companies Act", "Housing Code", "Civil Code", "Road Traffic Ordinance", "Roads Act", "Rules of Court", "{}-Gesetz", "{}-Lehre", "Mietgesetz", "Seeordnung", "Zivilprozessordnung", "Hafengesetz", "loi {}", "doctrine {}", "Code civil", "Code du travail", "règlement intérieur"]
SHIPS = ["", "", "", "MS ", "SS ", "MV ", "HMS ", "Lady ", "Queen ", "Star of ", "Saint "]
CURRENCIES = "crowns kroner francs pounds euros marks guilders pesos rupees roubles yen dinars shillings Euro Franken francs euros".split()
MONTHS = ["January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December", "Januar", "Februar", "März", "Mai", "Juni", "Juli", "Oktober", "Dezember", "janvier", "février", "mars", "avril", "mai", "juin", "juillet", "août", "septembre", "octobre", "novembre", "décembre"]
ENGLISH_STREETS = ["Street", "Road", "Lane", "Avenue", "Drive", "Close", "Court", "Terrace", "Quay", "Square", "Way", "Crescent", "Gardens", "Row", "Hill", "Bridge", "St", "Rd", "Ave", "St.", "Rd."]
GERMAN_STREETS = ["straße", "strasse", "str.", "weg", "gasse", "platz", "allee", "ring", "ufer", "damm"]
FRENCH_STREETS = ["rue", "rue de", "rue du", "rue des", "rue de la", "avenue", "avenue de", "boulevard", "quai", "quai des", "place", "impasse", "impasse des", "chemin", "chemin du", "allée", "allée des", "cours"]
HIDDEN = ["█████", "████████", "*****", "[…]", "[redacted]", "[removed]", "[withheld]", "[anonymised]", "[deleted]", "[name withheld]", "[address removed]", "[phone removed]", "[email hidden]", "[number deleted]"]


class Maker:
    """Made-up items from one random source."""

    def __init__(self, seed: int) -> None:
        self.rng = random.Random(seed)

    def digits(self, n: int) -> str:
        return "".join(self.rng.choice("0123456789") for _ in range(n))

    def form(self, pattern: str) -> str:
        """Digits for # and capital letters for @."""
        return re.sub("[#@]", lambda m: self.digits(1) if m[0] == "#" else self.rng.choice("ABCDEFGHKLMNPRSTXYZ"), pattern)

    def word(self) -> str:
        """A capitalised word of random syllables, so that no list has to know it."""
        r = self.rng
        onset = ["b", "c", "d", "f", "g", "h", "j", "k", "l", "m", "n", "p", "r", "s", "t", "v", "w", "z", "br", "ch", "cl", "dr", "fl", "gr", "kr", "pl", "sch", "sh", "st", "sk", "sv", "th", "tr", "š", "ž", ""]
        vowel = ["a", "e", "i", "o", "u", "a", "e", "i", "o", "u", "y", "ä", "å", "é", "ö", "ø", "ü", "ai", "au", "ee", "ei", "ou"]
        coda = ["", "", "", "n", "r", "l", "s", "t", "m", "ck", "ll", "nd", "ng", "rt", "ss", "st", "ts", "rn", "x"]
        ending = ["", "", "", "son", "sen", "ski", "ova", "ić", "berg", "stein", "ton", "ham", "ford", "field", "wood", "ley", "mann", "er", "ini", "eau", "es", "ova", "a", "o", "ström", "haus", "burg", "heim", "ville", "port", "stad"]
        made = "".join(r.choice(onset) + r.choice(vowel) + r.choice(coda) for _ in range(r.choice([1, 2, 2, 2, 3]))) + r.choice(ending)
        return made.capitalize()

    def given(self) -> str:
        first = self.rng.choice(GIVEN) if self.rng.random() < 0.35 else self.word()
        return f"{first}-{self.word()}" if self.rng.random() < 0.03 else first

    def surname(self) -> str:
        r = self.rng
        one = lambda: r.choice(FAMILY) if r.random() < 0.3 else self.word()
        x = r.random()
        if x < 0.09:
            return f"{one()}-{one()}"
        if x < 0.16:
            return r.choice(["von ", "van ", "van der ", "de ", "de la ", "di ", "del ", "bin ", "al-", "O'", "Mac", "d'", "ten ", "zu "]) + one()
        return one()

    def F(self) -> str:
        r = self.rng
        middle = f"{r.choice('ABCDEFGHJKLMNPRSTVWŠŽ')}. " if r.random() < 0.16 else f"{self.given()} " if r.random() < 0.04 else ""
        name = f"{self.given()} {middle}{self.surname()}"
        return name.upper() if r.random() < 0.16 else name

    def S(self) -> str:
        s = self.surname()
        return s.upper() if self.rng.random() < 0.16 else s

    def R(self) -> str:
        name = f"{self.surname()}, {self.given()}"
        return name.upper() if self.rng.random() < 0.1 else name

    def J(self) -> str:
        r = self.rng
        return f"{r.choice('ABCDEFGHJKLNPRSTVWŠŽ')}. {r.choice('ABCDEFGHKLMNPRST') + '. ' if r.random() < 0.15 else ''}{self.surname()}"

    def G(self) -> str:
        return f"{self.given()} {self.surname()}".lower()

    def E(self) -> str:
        r, a, b = self.rng, self.given().lower(), self.word().lower()
        user = r.choice([a, f"{a[0]}{b}", f"{a}.{b}", f"{a}_{b}", f"{a}-{b}", f"{a}{self.digits(2)}", f"{b}+{r.choice(['news', 'shop', 'x', 'list'])}", f"{a}.{b}{self.digits(1)}", r.choice(["info", "hello", "admin", "sales", "contact", "enquiries"])])
        name = r.choice([self.word().lower(), f"{self.word().lower()}-{self.word().lower()}", r.choice(["mail", "post", "web", "school", "clinic"])])
        host = r.choice(["", "", "", "mail.", "www2.", "staff."]) + name + r.choice([".com", ".org", ".net", ".edu", ".de", ".fr", ".co.uk", ".ch", ".info", ".eu", ".example", ".test", ".invalid"])
        if r.random() < 0.32:
            at = r.choice([" [at] ", " (at) ", "(at)", "[at]", " at ", " AT ", "_at_"])
            dot = r.choice([".", ".", " [dot] ", " (dot) ", " dot ", "(dot)"]) if at != " at " else " dot "
            return user.replace(".", dot if r.random() < 0.4 else ".") + at + host.replace(".", dot)
        made = f"{user}@{host}"
        return made.upper() if r.random() < 0.08 else made

    def groups(self, total: int) -> list[str]:
        """``total`` digits in groups of two to four."""
        out = []
        while total:
            n = self.rng.choice([k for k in (2, 3, 4) if k <= total and total - k != 1] or [total])
            out.append(self.digits(n))
            total -= n
        return out

    def P(self) -> str:
        r, d = self.rng, self.digits
        x = r.random()
        if x < 0.45:
            local = r.choice(["(###) ###-####", "###-###-####", "###-####", "(0##) ###-####", "0## #### ####", "0#### ######", "0##/#######", "0###/## ## ##", "0### ### ###", "0##-########", "0## ### ## ##", "0# ## ## ## ##", "0#.##.##.##.##", "0##.##.##.##.##", "0#-##-##-##-##", "0##-### ####", "07### ######", "(0####) ######", "(0##) #### ####"])
            return self.form(local)
        country = r.choice(["1", "7", "33", "39", "41", "44", "49", "31", "48", "351", "420", "358", "972", d(2), d(3), d(3)])
        before = r.choice(["+", "+", "+", "00"]) + country
        y = r.random()
        if y < 0.3:
            return before + r.choice(["", " "]) + d(r.randint(8, 10))
        sep = r.choice([" ", " ", " ", "-", ".", "."])
        zero = r.choice([" (0)", "(0)", " (0) "]) if y > 0.75 else sep
        return before + zero + sep.join(self.groups(r.randint(8, 11)))

    def I(self) -> str:  # noqa: E743
        return self.form(self.rng.choice(["###-##-####", "###-##-####", "@@ ## ## ## @", "@@######@", "@#######@", "@ #### ####", "@########", "@@########", "@@-######-#", "@@#######", "# ## ## ## ### ###", "# ## ## ## ### ### ##", "## ### ### ###", "### ### ####", "######-####", "######-####", "##.##.##-###.##", "###.####.####.##", "####.####.####", "##########", "###########", "## ###### @ ###"]))

    def town(self) -> str:
        return self.rng.choice(TOWNS) if self.rng.random() < 0.3 else self.word() + self.rng.choice(["", "", "", "", " am Main", "-sur-Mer", " upon Tyne"])

    def street(self) -> str:
        return self.rng.choice(["High", "Church", "Station", "Park", "Mill", "King", "Queen", "Victoria", "Bridge"]) if self.rng.random() < 0.2 else self.word()

    def A(self) -> str:
        r = self.rng
        no = f"{r.randint(1, 240)}{r.choice(['', '', '', '', 'A', 'B', 'a', 'b', 'c'])}"
        x = r.random()
        if x < 0.55:
            made = f"{no} {self.street()} {r.choice(ENGLISH_STREETS)}"
            if r.random() < 0.3:
                made = f"{r.choice(['Flat', 'Apt.', 'Apt', 'Unit', 'Suite', 'Apartment', 'Room'])} {r.randint(1, 60)}{r.choice([', ', ', ', ' '])}{made}"
            if r.random() < 0.7:
                made += ", " + self.town() + r.choice(["", "", self.form(", @@ #####"), self.form(" ####"), self.form(" @@# #@@"), self.form(" #####"), self.form(", @@#@ #@@")])
            return made
        if x < 0.78:
            name = self.word()
            made = r.choice([f"{name}{r.choice(GERMAN_STREETS)}", f"{name}{r.choice(GERMAN_STREETS)}", f"{name}{r.choice(GERMAN_STREETS)}", f"{name}-{r.choice(['Straße', 'Weg', 'Platz'])}", f"{name} {r.choice(['Allee', 'Straße', 'Weg', 'Ring', 'Damm'])}", f"{r.choice(['Am', 'An der', 'Im', 'Zum'])} {name}"]) + f" {no}"
            return made + (f", {r.choice(['', '', 'D-', 'A-'])}{self.digits(r.choice([4, 5, 5]))} {self.town()}" if r.random() < 0.75 else "")
        made = f"{no}{r.choice(['', ',', ',', ' bis', ' ter,'])} {r.choice(FRENCH_STREETS)} {self.word()}"
        return made + (f", {self.digits(r.choice([4, 5, 5]))} {self.town()}" if r.random() < 0.8 else "")

    def C(self) -> str:
        r = self.rng
        x = r.random()
        if x < 0.07:
            return r.choice(BODIES).format(self.town())
        name = r.choice([self.word(), self.word(), self.word(), self.surname(), f"{self.surname()} & {self.surname()}", f"{self.word()} {self.word()}"])
        made = f"{name} {r.choice(FIRMS)}"
        return made.upper() if r.random() < 0.06 else made

    def V(self) -> str:
        r = self.rng
        name = r.choice([self.word(), self.word(), f"{self.word()} {self.word()}", f"{self.word()} {self.word()}", f"{r.choice(GIVEN)} {self.word()}", f"{self.word()} {r.choice(['II', 'III', 'Star'])}"])
        return r.choice(SHIPS) + name

    def T(self) -> str:
        return self.town()

    def W(self) -> str:
        r = self.rng
        x = r.random()
        if x < 0.75:
            return f"{self.street()} {r.choice(ENGLISH_STREETS)}"
        return f"{self.word()}{r.choice(GERMAN_STREETS)}" if x < 0.9 else f"{r.choice(FRENCH_STREETS)} {self.word()}"

    def N(self) -> str:
        r = self.rng
        x = r.random()
        if x < 0.2:
            return self.P()
        if x < 0.35:
            return self.I()
        if x < 0.4:
            return "@" + self.word().lower()
        return self.form(r.choice(["####", "#####-####", "######/####", "##/##", "##.##.##", "@-##", "@-#", "@@@ ### ### #", "@@@ #####", "@@@ ######", "##-###", "#######", "@@##########", "#/##", "@@-####", "No. ###", "@#@ ###"]))

    def D(self) -> str:
        r = self.rng
        d, y = r.randint(1, 28), r.randint(1960, 2026)
        return r.choice([f"{d} {r.choice(MONTHS)} {y}", f"{d} {r.choice(MONTHS)} {y}", f"{r.choice(MONTHS[:12])} {d}, {y}", f"{d}. {r.choice(MONTHS[:20])} {y}", f"{d:02}.{r.randint(1, 12):02}.{y}", f"{y}-{r.randint(1, 12):02}-{d:02}", f"{d}/{r.randint(1, 12)}/{y}", f"{r.choice(MONTHS)} {y}", f"{y}"])

    def M(self) -> str:
        r = self.rng
        n = r.randint(20, 9999999)
        return r.choice([f"{n:,} {r.choice(CURRENCIES)}", f"{n:,} dollars", f"EUR {n:,}", f"£{n:,}", f"${n:,}", f"{n} EUR", f"{n:,}.50", f"CHF {n}", f"{n} francs", f"{n} €", f"{n:,} {r.choice(CURRENCIES)}", f"{r.choice(['USD', 'SEK', 'PLN', 'JPY'])} {n:,}", f"€{n:,}.00"])

    def K(self) -> str:
        r = self.rng
        roman, letter, year = r.choice(["I", "II", "III", "IV", "V", "VI", "X"]), r.choice(["C", "O", "R", "S", "W", "U", "B", "ZR", "StR", "AZR", "Sa", "K"]), r.randint(1970, 2026)
        n = r.randint(1, 999)
        return r.choice([f"{r.randint(1, 30)} {letter} {n}/{year % 100:02}", f"{roman} {letter} {n}/{year % 100:02}", f"No. {n} of {year}", f"{year}/{n}", f"{self.word()[:3].upper()}-{year}-{self.digits(4)}", f"{r.choice(['CV', 'HC', 'B', 'RG'])}-{year}-{n}", f"{year % 100:02}-{self.digits(5)}", f"RG {year % 100:02}/{self.digits(5)}"])

    def Q(self) -> str:
        r = self.rng
        n, year = r.randint(1, 999), r.randint(1950, 2026)
        letters = "".join(r.choice("ABCDEFHKLMNOPRSTUV") for _ in range(r.choice([2, 3, 3, 4])))
        cite = r.choice([f"[{year}] {letters} {n}", f"({year}) {r.randint(1, 90)} {letters} {n}", f"{letters[:2]}:{letters[1:3]}:{year}:{n}"])
        dotted = ".".join(letters[:3]) + "."
        word = self.word()[:4].capitalize()
        report = f"{r.randint(1, 120)} {r.choice([dotted, dotted, f'{word}. {dotted[:4]}', f'{word}. Rep.', f'Bull. {word}.', 'F. Supp.', 'All ER', 'BGHZ', 'NJW'])} {n}"
        parties = f"{self.C()} v. {r.choice([self.C(), self.C(), f'{letters[0]}.{letters[1]}.', r.choice(BODIES).format(self.town())])} {cite}"
        return r.choice([cite, cite, report, report, parties, parties, self.K()])

    def H(self) -> str:
        made = self.rng.choice(COURTS).format(self.town())
        return made.upper() if self.rng.random() < 0.1 else made

    def L(self) -> str:
        return self.rng.choice(LAWS).format(self.word())

    def n(self) -> str:
        return self.rng.choice(NOUNS) if self.rng.random() < 0.8 else f"{self.rng.choice(NOUNS)} {self.rng.choice(NOUNS)}"

    def a(self) -> str:
        return self.rng.choice(ADJECTIVES)

    def v(self) -> str:
        return self.rng.choice(VERBS)

    def h(self) -> str:
        r = self.rng
        one, two = r.choice(NOUNS), r.choice(NOUNS)
        made = r.choice([one, f"{r.choice(ADJECTIVES)} {one}", f"{r.choice(ADJECTIVES)} {one}", f"{one} of {two}", f"{one} on the {two}", f"a {one} to {r.choice(['pay', 'act', 'repair', 'give notice'])}", f"an {r.choice(['error', 'objection', 'omission'])} in the {two}", f"the {one} of a {r.choice(ADJECTIVES)} {two}"])
        return made.upper() if r.random() < 0.05 else made[0].upper() + made[1:] if r.random() < 0.6 else made

    def x(self) -> str:
        return self.rng.choice(GERMAN_WORDS) if self.rng.random() < 0.4 else self.rng.choice(GERMAN_PARTS) + self.rng.choice(GERMAN_ENDS)

    def y(self) -> str:
        return self.rng.choice(GERMAN_VERBS)

    def w(self) -> str:
        made = self.rng.choice(GERMAN_ADJECTIVES)
        return made.capitalize() if self.rng.random() < 0.2 else made

    def m(self) -> str:
        made = self.rng.choice(FRENCH_NOUNS)
        return made.capitalize() if self.rng.random() < 0.15 else made

    def o(self) -> str:
        return self.rng.choice(FRENCH_ADJECTIVES)

    def u(self) -> str:
        return self.rng.choice(FRENCH_VERBS)

    def open(self) -> str:
        return self.rng.choice(OPENERS)

    def offen(self) -> str:
        return self.rng.choice(OPENERS_GERMAN)

    def role(self) -> str:
        return self.rng.choice(ROLES)

    def head(self) -> str:
        return self.rng.choice(HEADINGS)

    def thing(self) -> str:
        return self.rng.choice(THINGS)

    def paper(self) -> str:
        return self.rng.choice(PERSONAL_PAPERS)

    def line(self) -> str:
        return self.rng.choice(LINES)

    def stay(self) -> str:
        return self.rng.choice(STAYS)

    def act(self) -> str:
        return self.rng.choice(ACTS)

    def hidden(self, slot: str) -> str:
        """A redacted item: a placeholder, initials, or an item most of whose characters are starred out."""
        r = self.rng
        if slot in "FSRJG" and r.random() < 0.6:
            letters = [r.choice("ABCDEFGHJKLMNPRSTVWŠŽ") for _ in range(3)]
            return r.choice([f"{letters[0]}.", f"{letters[0]}.{letters[1]}.", f"{letters[0]}. {letters[1]}.", f"{letters[0]}.{letters[1]}.{letters[2]}.", "X.", "N.N."])
        if slot in "EPI" and r.random() < 0.6:
            whole = getattr(self, slot)()
            keep = r.randint(1, 3)
            seen = 0
            out = ""
            for c in whole:
                seen += c.isalnum()
                out += "*" if c.isalnum() and seen > keep else c
            return re.sub(r"(?<=\*)\.(?=\*+$)", "", out)
        return r.choice(HIDDEN)

    def fill(self, slot: str) -> tuple[str, str | None]:
        """A filling and the kind it is labelled with, if any."""
        if slot in PERSONAL:
            x = self.rng.random()
            if x < 0.10:
                return self.hidden(slot), None
            if x < 0.15 and slot in "EPIA":  # any place may hold something else, so the form of an item counts too
                return getattr(self, self.rng.choice("DDMMKQCTWL"))(), None
            if x < 0.13 and slot in "FSRJ":
                return getattr(self, self.rng.choice("CCHDQLh"))(), None
            return getattr(self, slot)(), PERSONAL[slot]
        return getattr(self, slot)(), None


def labelled(rounds: int = 30, seed: int = 7) -> Iterator[tuple[str, list[tuple[int, int, str]]]]:
    """(text, [(start, end, kind)]): passages of a few lines each."""
    m = Maker(seed)
    lines = [*(x for part in (ENGLISH, GERMAN, FRENCH, PAPERS, PAPERS) for x in part.split("\n") if x), *FORMS]
    for _ in range(rounds):
        m.rng.shuffle(lines)
        at = 0
        while at < len(lines):
            n = m.rng.randint(1, 4)
            text, spans = "", []
            for line in lines[at : at + n]:
                text += m.rng.choice(["\n", "\n", "\n", " ", " ", "\n\n"]) if text else ""
                text += m.rng.choice(["", "", "", "", f"{m.rng.randint(1, 60)}. ", f"{m.rng.randint(1, 60)}\t", f"[{m.rng.randint(1, 60)}] ", f"§ {m.rng.randint(1, 60)} ", f"({m.rng.randint(1, 20)}) ", "- "])
                loud = m.rng.random() < 0.06
                for k, part in enumerate(re.split(r"\{(\w+)\}", line)):
                    made, kind = (part, None) if k % 2 == 0 else m.fill(part)
                    made = made.upper() if loud else made
                    if kind:
                        spans.append((len(text), len(text) + len(made), kind))
                    text += made
            if m.rng.random() < 0.25:  # lines are often broken anywhere
                text = re.sub(" ", lambda _: "\n" if m.rng.random() < 0.12 else " ", text)
            yield text, spans
            at += n
