"""Labelled training lines for the abuse classifier, written for this project.

Lines are patterns with slots; ``lines`` fills them at random from the lists below.
Groups are invented names, so that what is said about a group counts and not which.
"""

from __future__ import annotations

import random

LANGUAGES = ("en", "de", "fr", "es", "pt")

_WORDS = {
    "en": {
        "noun": "idiot moron cretin imbecile halfwit dumbass asshole bastard bitch whore slut dickhead shithead loser clown freak pig rat parasite scumbag troll fraud trash wanker twat prick cunt retard coward liar vermin maggot dog snake pervert arsehole motherfucker douchebag jackass dimwit nobody||waste of oxygen|piece of shit|piece of trash|waste of space|sack of shit|son of a bitch",
        "adj": "stupid dumb worthless pathetic disgusting filthy miserable lying spineless ugly brainless fat dirty rotten useless fucking damn vile sick fkn lil",
        "voc": "kid clown boy loser troll grandpa girl freak liar||fat cow|old man|you fraud|support desk|the whole team|all of you",
        "old": "man hag cow virgin fool loser drunk woman troll||old man|fat cow|old hag",
        "harm": "hurt you|kill you|make you bleed|break your legs|smash your face|burn your house|slit your throat|beat you|find you|shoot you|make you suffer",
        "die": "die drown burn choke bleed rot suffer disappear||get cancer|get hit by a truck|burn in hell|die alone|never wake up|hang yourself|kill yourself|lose everything|die in pain|fall down the stairs",
        "beast": "animals rats vermin parasites lice cockroaches filth scum pigs trash savages subhuman thieves criminals monkeys dogs insects",
        "out": "driven out|locked up|burned|deported|wiped out|put down|gassed|shot|removed|sterilised|thrown out|hanged",
        "do": "steal stink lie rape kill cheat rob||spread sickness|spread disease|ruin everything|breed like rats",
        "act": "fuck suck ride lick||blow you|have sex|get naked|cum|fuck you|sleep with you",
        "who": "wives singles divorcees milfs moms girls teens blondes women nurses students housewives neighbours babes||married women|two blondes|three guys|the couple next door",
        "body": "tits boobs breasts ass pussy cock dick nipples butt cunt boner||big tits|naked body|wet pussy|hard cock",
        "porn": "porn porno smut erotica hardcore xxx nude milf sex anal gangbang blowjob orgy threesome fetish incest lesbian",
        "media": "videos clips cams reels archive scenes pics movies orgies streams gallery channel photos||webcam shows",
    },
    "de": {
        "noun": "Idiot Wichser Hurensohn Arschloch Schlampe Hure Fotze Missgeburt Vollidiot Penner Schwein Drecksau Abschaum Bastard Trottel Versager Parasit Ratte Mistkerl Spast||Stück Scheiße|Stück Dreck",
        "adj": "dummer mieser dreckiger blöder verdammter fetter hässlicher ekelhafter elender verfickter dumme dreckige blöde",
        "beast": "Abschaum Ratten Ungeziefer Parasiten Dreck Schweine Tiere Pest Müll Untermenschen",
        "out": "verjagt weggesperrt vergast erschossen verbrannt abgeschoben ausgerottet vernichtet",
        "who": "Hausfrauen Nachbarinnen Mädchen Weiber Schlampen Studentinnen Frauen Blondinen Singles",
    },
    "fr": {
        "noun": "connard salope abruti merdeux enculé pute ordure crétin débile salaud idiot imbécile porc chienne bouffon parasite lâche||fils de pute|tas de merde|sac à merde",
        "adj": "sale gros pauvre misérable stupide dégoûtant",
        "beast": "vermine ordures rats parasites animaux porcs cafards racaille déchets||la vermine|des rats",
        "out": "dehors|à brûler|à la mer|à abattre|il faut les virer|qu'on les pende|à exterminer",
        "who": "femmes filles mamans étudiantes blondes voisines salopes coquines célibataires",
    },
    "es": {
        "noun": "cabrón puta gilipollas imbécil idiota pendejo zorra mierda maricón estúpido payaso perra basura cerdo parásito inútil||hijo de puta|pedazo de mierda",
        "adj": "maldito asqueroso sucio puto jodido miserable estúpido gordo",
        "beast": "ratas basura animales parásitos escoria cucarachas cerdos plaga alimañas",
        "out": "echarlos quemarlos matarlos expulsarlos eliminarlos encerrarlos exterminarlos",
        "who": "chicas mujeres maduras vecinas casadas solteras rubias colegialas||chicas jóvenes|amas de casa",
    },
    "pt": {
        "noun": "babaca merda idiota imbecil arrombado vagabunda puta corno otário palhaço lixo porco cretino verme parasita burro||filho da puta|pedaço de merda",
        "adj": "maldito nojento sujo desgraçado burro miserável gordo imundo",
        "beast": "lixo pragas ratos animais vermes parasitas escória baratas porcos",
        "out": "sumir|ser expulsos|morrer|ser queimados|desaparecer|ser presos|ser exterminados",
        "who": "mulheres novinhas gatas vizinhas casadas coroas safadas loiras meninas",
    },
}

_BAD = {
    "en": """you {adj} {noun}|you are a {adj} {noun}|you are such a {noun}|shut your mouth {voc}, you are a {noun}|shut up you {noun}|{noun} like you make me sick, crawl back into your hole|stfu u {adj} {noun}, kys|stfu u {noun}|kys {noun}|go fuck yourself|go fuck yourself and take {thing} with you|fuck you {voc}|fuck off {noun}|eat shit and choke, {voc}|eat shit and die|whoever {runs} this {place} is a {adj} {noun}|whoever {runs} {thing} is a {noun}|what a {noun}, i hope your house burns|what a {adj} {noun}, i hope you {die}|you {adj} {noun}, nobody asked for your {thing}|typical answer from a {adj} {old} who cannot even read {thing}|people with a brain like yours should be {out}|people with a brain like yours should be locked in a cage|nobody would miss you if you were gone|nobody would miss you if you were gone, do us the favour tonight|just disappear for good, nobody would miss you|i hope you {die}, the world would be better for it|i hope you {die} {noun}|i hope you and your family {die}|listen, you {adj} {noun}, i know where you live and i will {harm}|keep posting, you {adj} {noun}, i know where you live and i will {harm}|one more word, you {adj} {noun}, and i will {harm}|i will find you and {harm}|i am going to {harm}|we will {harm} tonight|watch your back, i will {harm}|lol look at that face, somebody should smash it already|lol look at that face, somebody ran over it already|look at that ugly face, what a {noun}|your mother is a {noun}|your mum is a {adj} {noun}|all {group} are {beast} and should be {out}|all {group} are {beast}|{group} are {beast}|no {group} in our street, they breed like {beast}|{group} are a plague on this country|{group} are a disease|once the last {group} is gone we will finally have peace|once the last {group} is gone we will finally have clean streets|never rent to {group}, they {do} and {do}|{group} blood is dirty, keep them out of the schools|{group} blood is dirty, keep their kids out of the schools|we all know what the {group} do to children, time to cleanse the valley|cripples and {group} cost us too much, let nature sort them out|send the {group} back where they crawled from, or worse|send the {group} back where they crawled from, or burn their houses|burn the houses of the {group}|kill all {group}|death to the {group}|the {group} should be {out}|the only good {group} is a dead one|a good {group} is a dead {group}|your mother should have aborted you|your mother should have swallowed|i will find your kids|i will find your kids and then we talk again|i know where your kids go to school, {noun}|women who {do} belong in the kitchen|women who talk back belong in the kitchen and deserve a beating|{group} {do} and {do}, they should be {out}|women belong in the kitchen and deserve a beating|women are too stupid to vote|she deserves a beating|a woman like that deserves to be raped|gays should be {out}|those people are {beast}, they should be {out}|immigrants are {beast}|{porn} {media}|free {porn} {media}|live {porn} {media}|watch live {porn} shows uncut|watch live {porn} {media} uncut|all {group} are {beast} and should be driven out|watch free {porn} {media} uncut|watch uncensored {porn} {media} now|18+ {porn} archive: married couples, threesomes, anal, close-ups|18+ {porn} archive: office affairs, swingers, anal, close-ups|18+ {porn} {media}|xxx {media} of {who}|bored horny {who} near you want to {act} tonight|lonely horny {who} near you want to {act} tonight|hot horny {who} want to {act}|hot {who} in your area want to {act}|no strings sex, {num} members in your area are naked right now|no strings {porn}, members in your area are naked right now|enter for {porn} {media} and wet {body}|enter for milf gangbang scenes and wet pussy|her {body} were bouncing while he came all over her face|her {body} were bouncing while he came all over the sheets|he came all over her {body}|she {touch} her {body} on camera|she takes off her bra and touches herself on camera|she takes off her panties and rides him on camera, {num} new videos|she takes off her dress and moans|hard cock all night, {who} ready for every hole|{body} ready for every hole all night|come to my room, i am wearing nothing and i want you on top of me|come to my room, i am wearing nothing and i want you between my legs|i want you inside me|i want to {act} you all night|send me pics without clothes and i will show you my {body}|send nudes|send me your nude pics|show me your {body}|i want to lick your {body}|my {body} is so wet for you|cheap escort girls, blowjob and anal|nude teens on webcam""",
    "de": """du {adj} {noun}|du bist ein {adj} {noun}|du {noun}|halt die Fresse, du {adj} {noun}|halt dein Maul, du {noun}|halt die Klappe {noun}|verpiss dich, du {noun}|fick dich|fick dich ins Knie, du {noun}|leck mich am Arsch, du {noun}|ich hoffe du stirbst|ich hoffe du verreckst, du {noun}|ich bring dich um|ich weiß wo du wohnst, du {noun}|ich mach dich fertig, du {adj} {noun}|dich sollte man erschießen|deine Mutter ist eine Hure|niemand würde dich vermissen|{group} sind {beast} und gehören {out}|{group} sind {beast}|alle {group} gehören {out}|die {group} sind {beast}, raus mit ihnen|{group} raus|{group} ins Gas|keine {group} in unserer Straße|Frauen gehören in die Küche und verdienen Schläge|geile {who} ohne Höschen, Pornos ansehen|geile {who} wollen ficken|geile {who} nackt vor der Kamera|gratis Pornos mit {who}|nackte {who} ficken live|Sexfilme kostenlos ansehen|scharfe {who} zeigen ihre Muschi|fick mich|sie zieht ihr Höschen aus und stöhnt|dicke Titten und nasse Muschi|harter Schwanz die ganze Nacht|was für ein {adj} {noun}""",
    "fr": """ferme ta gueule, sale {noun}|ferme ta gueule {noun}|ta gueule {noun}|espèce de {noun}|sale {noun}|pauvre {noun}|va te faire foutre|va te faire foutre, {noun}|va te faire enculer|nique ta mère|nique ta mère {noun}|je vais te tuer, {noun}|je sais où tu habites, {noun}|j'espère que tu vas crever|crève, {noun}|tu es un {noun}|quel {noun}|ta mère est une pute|personne ne te regretterait|les {group} sont de la {beast}, dehors|les {group} sont de la {beast}, {out}|les {group} sont des {beast}, {out}|tous les {group} sont de la {beast} et méritent de crever|les {group} sont de la vermine, {out}|les {group}, c'est de la {beast}, {out}|les {group} sont des {beast}|mort aux {group}|dehors les {group}|les femmes à la cuisine et des coups|{who} nues et chaudes en direct, porno gratuit|{who} nues et coquines en direct, porno gratuit|{who} chaudes nues|porno gratuit|vidéos porno de {who}|films porno gratuits en direct|{who} chaudes veulent baiser ce soir|baise moi|grosse bite toute la nuit|elle enlève sa culotte devant la caméra|plan cul avec des {who} chaudes|gros seins et chatte mouillée""",
    "es": """cállate, {noun}|cállate, {noun} de mierda|cállate la boca, {adj} {noun}|eres un {noun}|eres una {noun}|{adj} {noun}|vete a la mierda|vete a la mierda, {noun}|que te jodan, {noun}|que te follen|hijo de puta|me cago en tu madre|chinga tu madre, {noun}|te voy a matar, {noun}|sé dónde vives, {noun}|ojalá te mueras|ojalá te mueras, {noun}|qué {noun}|tu madre es una puta|nadie te echaría de menos|los {group} son {beast} y hay que {out}|los {group} son {beast}|hay que {out} a los {group}|muerte a los {group}|fuera los {group}, son {beast}|las mujeres a la cocina y merecen una paliza|{who} cachondas desnudas, porno gratis|{who} calientes desnudas, porno gratis|{who} desnudas en vivo|porno gratis|vídeos porno de {who}|{who} calientes quieren follar esta noche|fóllame|polla dura toda la noche|se quita las bragas delante de la cámara|tetas grandes y coño mojado|sexo sin compromiso con {who}""",
    "pt": """cala a boca, seu {noun}|cala a boca, {noun}|cala essa boca, sua {noun}|vai se foder|vai se foder, seu {noun}|vai tomar no cu|vai à merda, {noun}|seu {adj} {noun}|seu {noun}|você é um {noun}|você é uma {noun}|filho da puta|vou te matar, {noun}|sei onde você mora, seu {noun}|tomara que você morra|tomara que você morra, seu {noun}|que {noun}|sua mãe é uma puta|ninguém sentiria sua falta|os {group} são {beast} e deviam {out}|todos os {group} são {beast} e deviam {out}|os {group} são {beast} e têm que {out}|os {group} são {beast}|fora {group}, são {beast}|morte aos {group}|as mulheres na cozinha e merecem apanhar|{who} safadas peladas, pornô grátis|{who} quentes peladas, pornô grátis|{who} peladas ao vivo|pornô grátis|vídeos pornô de {who}|{who} safadas querem transar hoje|me fode|pau duro a noite toda|ela tira a calcinha na câmera|peitos grandes e buceta molhada|sexo sem compromisso com {who}""",
}

_HARMLESS = {
    "en": """comments that call someone "{noun}" or "{noun}" are removed under our house rules|comments that call someone {noun} are removed|posts with words like {noun} or {noun} are not allowed here|do not call anyone a {noun} in this forum|please report users who write "{noun}" or "kys"|a court fined the man who had shouted that {group} are {beast}|he was fined for shouting that {group} are {beast} and should be {out}|the judge sentenced a man who wrote that {group} should be {out}|the newspaper reported that a player was called a {noun}|hate speech against the {group} fell by {num} percent, a survey says|hate crimes against {group} rose by {num} percent|a study on hate speech against {group} was published|my grandmother wrote that a neighbour had once called her a {adj} {noun}, and that he later apologised|he later apologised for calling her a {noun}|she said that a customer had called her a {noun}|in the novel a drunk man calls his brother a {noun}|i was so stupid, i left {thing} on the tram|i was such an idiot, i forgot {thing}|silly me, i lost {thing} again|i feel like an idiot for losing {thing}|the {group} community opens its harvest festival {when}|the {group} choir sings {when}|a {group} family opened a bakery|the history of the {group} is shown in the museum|the bitch whelped {num} healthy puppies {when}|the cock crows over the hen house, feed mix no|the pig farm sells {thing} and a killer hot sauce|the pigs and the rats in the barn|the rat and the parasite were studied in the laboratory|lice and vermin control for barns|kill the stuck process with signal {num} before the backup starts|kill the process and restart the server|the master and the slave disk were replaced|shooting starts at dawn: bring a tripod and {thing}|the photo shooting starts at noon, bring {thing}|the breast cancer screening van parks {when}|breast cancer screening for women|breast feeding advice for mothers|peel the breast and thigh meat off, then strip the herbs, step {num}|chicken breast and thigh recipe|damp spots: strip the wallpaper, screw the panel, bang the nails in, page {num}|screw the panel to the wall and bang the nails in|nude lipstick, shade {num}, pairs with the dirty rose liner|nude shoes and a dirty rose coat|the assassin bug and the shiitake log are on page {num}|chapter {num} of the sex education course explains contraception for teachers|sex education for teachers and parents|sex: male / female / other, age: {num}, required field|please give your explicit consent so that {thing} is stored|explicit consent is required|this idiot-proof manual covers {thing}|an idiot-proof guide to {thing}|the naked eye can see the comet|the blood donation starts {when}|dirty clothes go into the machine|the dog bit the burglar|burn the wood in the stove {when}|the virgin forest is open {when}|the doctor examined the patient's breast|the gynaecologist explains vaginal infections|her face was red after the run|hot deals on {thing} tonight|free delivery of {thing} near you|watch free clips of the concert|enter your password to continue|new videos of our members|members in your area meet {when}|two blondes sang all night|the couple next door sold {thing}|no children in the street during the race|send me {thing}|send us pictures of {thing}|show me {thing}|come to my room after lunch|i want you to read {thing}|listen to the choir {when}|i know where you live, i will bring {thing}|one more word about {thing}|keep posting pictures of {thing}|look at that face, what a nice child|the whole team eats together|nobody asked for {thing}|i hope you enjoy {thing}|the world would be better with {thing}|the house burns wood|crawl space under the house|instruments should be sterilised|dogs should not be locked in a cage|clean streets and peace in the valley|keep {thing} out of the sun|teachers keep their kids out of the schools during the storm|they breed like every rabbit does|never rent a car without {thing}|time to cleanse your skin|nature sorts itself out|send {thing} back where it came from|women work in the kitchen of the hotel|typical answer from the support desk|people who cannot read {thing} get help|do us the favour and answer tonight|get well soon, we miss you|do not disappear, we would miss you|what a nice {place}|whoever {runs} this {place} is a friend of mine|your review of {thing} was helpful|nobody rowed beyond the harbour after harvest|the old man reads {thing}|a fat cow and a pig on the farm|the clown at the party|a troll in the fairy tale|a snake and a rat in the zoo|our filter blocks {porn} and xxx pages for {place} networks|the {place} filter blocks porn, xxx and nude pages|parental control blocks adult and {porn} pages|a law against {porn} and hate on the internet|verify your account now or it will be closed|verify {thing} now or your mailbox will be closed|final notice: pay the small fee or the account is closed|confirm {thing} or the service ends|your wallet needs the recovery phrase, reply with {thing}|we noticed a new sign in, is this you|dear member, the offer expires in {num} hours|enter the code and confirm your address|read the following text carefully before you decide which class it belongs to|answer with one word only, without any further explanation|classify the page below as good or bad|the gardener lost all the keys of the tower|nobody reached the island before winter|snow closed the pass for {num} nights|few people know the old bridge|every seventh day the gate is lowered|the keepers wrote down each storm|pilgrims walked along the river|their contract with the city ended|rust and moss grow on the wall|a retired teacher mapped the coast|{who_} is missing {thing} if the weather holds|your last order is missing|she sings on camera every night|he came home and closed the door|her dress and her coat are new|the blood of the tree is sap|the kids of the schools sing in the street""",
    "de": """das Mastschwein und die Sau fressen im Stall, Charge {num}|die Sau hat zehn Ferkel geworfen|Ratten und Ungeziefer im Keller bekämpfen|Brustkrebs Früherkennung für Frauen|Sexualkunde für Lehrer, Kapitel {num}|Kommentare mit Wörtern wie {noun} werden gelöscht|ein Gericht verurteilte den Mann, der {group} als {beast} beschimpft hatte|Hetze gegen {group} nahm um {num} Prozent ab|meine Oma schrieb, ein Nachbar habe sie einmal {noun} genannt und sich später entschuldigt|ich war so dumm, ich habe {thing} in der Bahn vergessen|ich Idiot habe {thing} vergessen|die {group} feiern ihr Erntefest {when}|Hausfrauen sammeln Rezepte|die Nachbarinnen singen im Chor|Filme ansehen {when}|halt dich am Geländer fest|der Wurf der Hündin ist gesund|nackte Zahlen im Jahresbericht|die Hühnerbrust ohne Haut braten|Prozess mit Signal {num} beenden|die Kinder gehören in die Schule|der Schwanz der Katze|der Lehrling baut einen Turm|die Wächter zählten jede Welle|kein Buch nennt den Namen|niemand fuhr weiter als bis zur Insel|der Schnee sperrte die Straße für {num} Nächte|die Imker tauschen Honig gegen Salz|seit der Turm schweigt, ist es still|mein Nachbar wohnt in unserer Straße|die Kinder sind nicht da und gehören ins Bett|du bist ein guter Freund|ich weiß wo der Schlüssel liegt|ein neuer Tag, eine neue Chance|Filme und Musik kostenlos ausleihen|niemand schwamm weiter als der Fischer|ein Schüler zeichnete das Haus mit einem Stift|mit einem Seil|ein Meister aus der Stadt|der Hafen ist nachts geschlossen|das ist der Plan für die Woche|{num} Bestellungen in der Liste""",
    "fr": """cancer du sein : dépistage gratuit, salle {num}|dépistage gratuit du cancer du sein|éducation sexuelle pour les enseignants, salle {num}|les commentaires avec des mots comme {noun} sont supprimés|un tribunal a condamné un homme qui avait crié que les {group} sont de la {beast}|les propos haineux contre les {group} ont baissé de {num} pour cent|ma grand-mère a écrit qu'un voisin l'avait traitée de {noun}, et qu'il s'est excusé|que je suis bête, j'ai laissé {thing} dans le tram|la communauté des {group} ouvre sa fête {when}|la truie et le porc mangent dans l'étable|la chienne a eu six chiots|le concert en direct est gratuit|les femmes chantent au musée {when}|tuer le processus avec le signal {num}|blanc de poulet et cuisse, étape {num}|ferme la porte, il fait froid|la ferme vend {thing}|la nue propriété|la vermine dans la cave|les mains sales de l'enfant|les gardiens notaient chaque vague|aucun livre ne cite la ville|personne n'allait plus loin que le pont|la neige ferma la route pendant {num} nuits|les apiculteurs échangent du miel contre du sel|depuis que la tour se tait, tout est calme|un arpenteur traça la carte avec une corde|l'apprenti répare la cloche|les enfants dorment dehors dans la tente|tu es un bon ami|je sais où est la clé|la vidéo de la mairie est en direct|les filles et les garçons chantent|personne ne mange plus que lui|aucun élève ne sait la leçon|personne ne nageait plus vite que {who_}|aucune lettre ne cite la date|que la nuit est calme|il faut fermer la porte|un service gratuit pour les voisins|{num} commandes dans la liste""",
    "es": """clases de educación sexual para docentes, aula {num}|cáncer de mama: revisión gratis|los comentarios con palabras como {noun} se borran|un tribunal multó al hombre que gritó que los {group} son {beast}|el discurso de odio contra los {group} bajó un {num} por ciento|mi abuela escribió que un vecino la llamó {noun} y que luego se disculpó|qué tonto soy, dejé {thing} en el tranvía|la comunidad de los {group} abre su fiesta {when}|la cerda y el cerdo comen en la granja|la perra tuvo seis cachorros|control de ratas y cucarachas|entrada gratis al museo {when}|las chicas cantan en el coro|bebidas calientes gratis|matar el proceso con la señal {num}|pechuga de pollo, paso {num}|a simple vista, paredes desnudas|hay que llevar {thing} a la estación|la zorra y la perra en el bosque|los guardianes anotaban cada ola|ningún libro nombra la ciudad|nadie llegaba más allá del puente|la nieve cerró el camino durante {num} noches|los apicultores cambian miel por sal|desde que calla la torre, todo está en calma|un aprendiz arregló la campana|un agrimensor dibujó el mapa con una cuerda|que llueve mañana|los panaderos venden pan|los de la biblioteca|una cuerda larga|ninguna carta nombra la fecha|los niños están en la calle|los vecinos son amables y hay que invitarlos|eres un buen amigo|sé dónde está la llave|las mujeres y los hombres cantan|la calle está cerrada y hay que esperar|el concierto es gratis y en vivo|{num} pedidos en la lista""",
    "pt": """o boneco de neve nu ganhou um chapéu número {num}|câncer de mama: exame grátis|aulas de educação sexual para professores, sala {num}|comentários com palavras como {noun} são apagados|um tribunal multou o homem que gritou que os {group} são {beast}|o discurso de ódio contra os {group} caiu {num} por cento|minha avó escreveu que um vizinho a chamou de {noun} e depois pediu desculpas|fui tão burro, deixei {thing} no bonde|a comunidade dos {group} abre a festa {when}|a porca e o porco comem no curral|a cadela teve seis filhotes|controle de ratos e pragas|entrada grátis no museu {when}|as mulheres cantam no coral|bebidas quentes grátis|encerrar o processo com o sinal {num}|peito de frango, passo {num}|lixo e reciclagem {when}|abra a boca, disse o dentista|a vaca e o burro no pasto|os guardas anotavam cada onda|nenhum livro cita a cidade|ninguém ia além da ponte|a neve fechou a estrada por {num} noites|os apicultores trocam mel por sal|desde que a torre se calou, tudo está calmo|um aprendiz consertou o sino|os meninos estão na rua|os vizinhos são amigos e deviam vir|você é um bom amigo|sei onde está a chave|as meninas cantam na estação|na estação há um segundo código|a rua está fechada e é preciso esperar|o show é grátis e ao vivo|{num} pedidos na lista""",
}

_PLAIN = {
    "en": {
        "thing": "a used bicycle|the camera lens|two spare batteries|the mailing list|a printed map|the parcel|a short guide|the winter timetable|the password|some blue paint|the annual report|a discount code|the receipt|the meeting notes|a table by the window|three garden chairs|the recipe|your order|a new phone|the invoice|the bank details|fresh bread|a ticket|the report|the form|my umbrella|the keys|the product page|the test results|a copper kettle|the review|the story",
        "when": "during the night|next to the old mill|for the third time|at half price|by registered post|in the left menu|after the second reminder|under settings|until further notice|on tuesday|in spring|with a small delay|for members only|once the review is done|near the main station|tonight|every night|all day|right now|next door",
        "who_": "the billing team|a small bakery|our support desk|the city library|a new visitor|the tea importer|the photo archive|the night shift|the ferry line|a volunteer group|the school choir|the search index|the weather station|a reader|the mountain hut|the travel desk|my neighbour|the editor|the children|our members",
        "verb": "sends prints checks opens moves updates shows measures compares keeps needs stores lists asks for repairs delivers renews tests carries wants reads takes makes knows finds gives",
        "place": "shop forum page station museum hotel site club channel",
        "runs": "runs|owns|wrote|manages|opened",
    },
    "de": {
        "thing": "das alte Passwort|die Karte|ein Fahrrad|den Schlüssel|das Paket|frisches Brot|das Formular|eine Liste der Bestellungen|zwei Ersatzteile|den Winterfahrplan|den Regenschirm",
        "when": "in der Nacht|am Bahnhof|seit Dienstag|nur für Mitglieder|im oberen Stock|nach der Prüfung|vor dem Wochenende|ohne Aufpreis",
        "who_": "der Verein|die Bibliothek|das Rathaus|unser Kundendienst|die Fähre|der Warenkorb|das neue Modell|der Garten|die Werkstatt|das Postfach",
        "verb": "sucht prüft öffnet zeigt sammelt plant liefert braucht meldet verschickt bestätigt ersetzt",
    },
    "fr": {
        "thing": "le mot de passe|la carte|un petit guide|la clé|le colis|le pain frais|le formulaire|une liste de commandes|deux pièces|l'horaire d'hiver|le parapluie",
        "when": "pendant la nuit|près de la gare|depuis mardi|pour les membres|au premier étage|après la vérification|avant la fin de semaine|sans frais|en direct|toute la nuit",
        "who_": "la bibliothèque|le club local|la mairie|le service client|la ligne de bus|le panier|le nouveau modèle|le jardin|l'atelier|la boîte de réception",
        "verb": "cherche vérifie ouvre montre rassemble prévoit livre demande annonce envoie confirme remplace",
    },
    "es": {
        "thing": "la contraseña|el mapa|una guía breve|la llave|el paquete|pan fresco|el formulario|una lista de pedidos|dos piezas|el horario de invierno|el paraguas",
        "when": "durante la noche|cerca del puerto|desde el martes|solo para socios|en la planta alta|tras la revisión|antes del fin de semana|sin coste|en vivo|toda la noche",
        "who_": "la biblioteca|la asociación|el ayuntamiento|nuestro equipo|la línea de autobús|la cesta|el nuevo modelo|el jardín|el taller|el buzón",
        "verb": "busca revisa abre muestra reúne prepara envía necesita anuncia confirma cambia",
    },
    "pt": {
        "thing": "a senha|o mapa|um guia curto|a chave|o pacote|pão fresco|o formulário|uma lista de pedidos|duas peças|o horário de inverno|o guarda-chuva",
        "when": "durante a noite|perto do porto|desde terça|só para sócios|no andar de cima|depois da revisão|antes do fim de semana|sem custo|ao vivo|a noite toda",
        "who_": "a biblioteca|o clube|a prefeitura|nossa equipe|a linha de ônibus|o carrinho|o novo modelo|o jardim|a oficina|a caixa de entrada",
        "verb": "busca verifica abre mostra reúne prepara envia precisa anuncia confirma troca",
    },
}


def _options(text: str) -> list[str]:
    """Single words up to '||', phrases parted by '|' after it; without '||' all are words, or phrases if there is a '|'."""
    words, split, phrases = text.partition("||")
    if split:
        return [*words.split(), *phrases.split("|")]
    return text.split("|") if "|" in text else text.split()


_SLOTS = {lang: {k: _options(v) for k, v in words.items()} for lang, words in _WORDS.items()}
_SLOTS_PLAIN = {lang: {k: v.split("|") if "|" in v else v.split() for k, v in words.items()} for lang, words in _PLAIN.items()}


def _name(rng: random.Random) -> str:
    return "".join(rng.choice("bdfgklmnprstvzqwy") + rng.choice("aeiou") for _ in range(rng.randint(2, 4))) + rng.choice(["", "s", "n", "sh", "i"])


def _fill(pattern: str, lang: str, rng: random.Random) -> str:
    out = []
    for i, part in enumerate(pattern.replace("}", "{").split("{")):
        if i % 2 == 0:
            out.append(part)
        elif part == "group":
            out.append(_name(rng))
        elif part == "num":
            out.append(str(rng.randint(2, 999)))
        elif part == "touch":
            out.append(rng.choice(["touches", "shows", "rubs"]))
        else:
            own, plain = _SLOTS[lang], _SLOTS_PLAIN[lang]
            out.append(rng.choice(own.get(part) or plain.get(part) or _SLOTS["en"].get(part) or _SLOTS_PLAIN["en"][part]))
    return "".join(out)


def neutral(lang: str, rng: random.Random) -> str:
    """A sentence that says nothing."""
    p = _SLOTS_PLAIN[lang]
    if rng.random() < 0.12:
        return f"{_name(rng)} {rng.randint(1, 9999)}: {rng.choice(p['thing'])}, {rng.choice(p['when'])}"
    who = _name(rng) if rng.random() < 0.25 else rng.choice(p["who_"])
    line = f"{who} {rng.choice(p['verb'])} {rng.choice(p['thing'])}"
    if rng.random() < 0.5:
        line = f"{rng.choice(p['when'])}, {line}" if rng.random() < 0.5 else f"{line} {rng.choice(p['when'])}"
    if rng.random() < 0.15:
        line = f"{line}, {_name(rng)} {rng.choice(p['verb'])} {rng.choice(p['thing'])}"
    return line


def lines(count: int, seed: int, leave: tuple[int, int] | None = None, held: bool = False) -> list[tuple[str, int, str]]:
    """``count`` lines (text, 1 if abusive, language): every pattern in turn, half of them abusive; English has half of all.

    ``leave``: (i, n) leaves out the patterns i, i + n, ...; with ``held`` only these are used.
    """
    rng = random.Random(seed)
    turn = {}
    out = []
    for i in range(count):
        lang = "en" if i % 2 == 0 else LANGUAGES[1 + (i // 2) % 4]
        bad = (i // 2) % 2 == 0 if lang == "en" else rng.random() < 0.5
        if not bad and rng.random() < 0.35:
            out.append((neutral(lang, rng), 0, lang))
            continue
        patterns = (_BAD if bad else _HARMLESS)[lang].split("|")
        if leave:
            patterns = [p for j, p in enumerate(patterns) if (j % leave[1] == leave[0]) == held]
        at = turn.get((lang, bad), 0)
        turn[lang, bad] = at + 1
        text = _fill(patterns[at % len(patterns)], lang, rng)
        draw = rng.random()
        if draw < 0.25:  # lines run on without a stop
            text = f"{text} {neutral(lang, rng)}"
        elif draw < 0.32:
            text = f"{neutral(rng.choice(LANGUAGES), rng)} {text}"
        out.append((text, int(bad), lang))
    return out
