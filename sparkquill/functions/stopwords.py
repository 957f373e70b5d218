"""Short stop-word lists of the stemming configurations."""

ENGLISH = frozenset(
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs themselves what which who whom this that these those am is are was were be been being have has had having do does did doing a an the and but if or because as until while of at by for with about against between into through during before after above below to from up down in out on off over under again further then once here there when where why how all any both each few more most other some such no nor not only own same so than too very s t can will just don should now".split()
)
FRENCH = frozenset("au aux avec ce ces dans de des du elle en et eux il je la le leur lui ma mais me même mes moi mon ne nos notre nous on ou par pas pour qu que qui sa se ses son sur ta te tes toi ton tu un une vos votre vous c d j l à m n s t y été étée étées étés étant suis es est sommes êtes sont serai sera seront était étaient ai as avons avez ont avait avaient eu".split())
GERMAN = frozenset("aber alle allem allen aller alles als also am an ander andere anderem anderen auch auf aus bei bin bis bist da damit dann der den des dem die das dass daß du er sie es ein einem einen einer eines für gegen gewesen hab habe haben hat hatte hatten hier hin hinter ich mich mir ihr ihre ihrem ihren ihrer ihres im in indem ins ist jede jedem jeden jeder jedes jetzt kann kein keine können man manche mein meine mit muss nach nicht nichts noch nun nur ob oder ohne sehr sein seine sich sind so solche soll über um und uns unser unter viel vom von vor war waren was weg weil weiter welche wenn werde werden wie wieder will wir wird wo wollen zu zum zur zwar zwischen".split())
SPANISH = frozenset("de la que el en y a los del se las por un para con no una su al lo como más pero sus le ya o este sí porque esta entre cuando muy sin sobre también me hasta hay donde quien desde todo nos durante todos uno les ni contra otros ese eso ante ellos e esto mí antes algunos qué unos yo otro otras otra él tanto esa estos mucho quienes nada muchos cual poco ella estar estas algunas algo nosotros mi mis tú te ti tu tus ellas es soy eres somos son sea era eran fue fueron ha han he había ser".split())
