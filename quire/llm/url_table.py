"""The labelled URLs that the filter is trained on: invented hosts under reserved names, with the words, paths and forms of real ones."""

ALLOWED = """
https://www.citylibrary.example/catalogue/search?q=botany
https://library.northfield.example/opening-hours
http://museum-of-ports.example.org/collections/ships/4821
https://naturkundemuseum.example/ausstellung/voegel
https://www.riverside-university.example/faculty/physics/staff.html
https://cs.lakeside.example/courses/2023/algorithms/lecture-07.pdf
https://news.morningherald.example/world/2022/03/18/election-results
https://www.dailyharbour.example/politics/council-approves-budget
http://weather.coastwatch.example/forecast/weekend
https://wetter.alpenland.example/vorhersage/berge
https://docs.streamkit.example/en/latest/reference/windows.html
https://docs.python-tools.example/3/howto/logging.html
https://wiki.gardeners.example/index.php/Tomato_blight
https://en.fieldwiki.example/wiki/History_of_cartography
https://www.history-today.example/articles/roman-roads-in-britain
http://archive.townhall.example/minutes/1998/may.txt
https://science-letters.example/vol/12/issue/3/article/445
https://journal.ecology.example/abstract/10.1234/je.2020.118
https://www.rosegarden.example/pruning/when-to-prune
https://blog.kitchenlight.example/2021/06/lemon-tart
https://recipes.oldfarm.example/bread/sourdough-for-beginners
https://rezepte.landkueche.example/suppen/kartoffelsuppe
https://cuisine.provence.example/recettes/ratatouille
https://www.stmarys-school.example/term-dates
https://schule-am-see.example/aktuelles/sommerfest
https://health.countycouncil.example/vaccination/children
https://www.heartclinic.example/patients/after-surgery
https://travel.slowtrains.example/italy/florence-to-siena
https://voyages.bretagne.example/itineraires/cote-sauvage
https://viajes.andalucia.example/rutas/pueblos-blancos
https://music.chamberplayers.example/concerts/autumn
https://orchestra.example.org/tickets/season-2024
https://www.research-council.example/grants/open-calls
https://data.oceanography.example/datasets/salinity/1990-2010
https://maps.hikers.example/trails/ridge-walk
https://www.cycleclub.example/routes/flat-lands.html
https://shop.bookbinders.example/paper/handmade
https://store.woodworks.example/chisels/bevel-edge?page=2
https://forum.beekeepers.example/t/wintering-hives/3312
https://community.opensourcecad.example/questions/88123
https://support.printco.example/drivers/laser-400
https://help.ledgerbook.example/articles/how-to-reconcile
https://www.parliament.example/bills/second-reading/217
https://gov.example/services/renew-passport
https://tax.example.gov.example/forms/self-assessment
https://court-records.example/judgments/2019/civil/1042
https://www.peoplesbank.example/branches/high-street
https://kinderbuch.example/autoren/lesungen
https://poetry.example.net/anthology/spring
https://letters.example.net/correspondence/1841/jan
https://film-archive.example/silent/1924/harbour-lights
https://theatre.example.com/programme/the-tempest
https://astronomy.example.org/observing/meteor-showers
https://geology.example.edu.example/field-trips/limestone
https://birdsurvey.example/species/lapwing
https://farmersmarket.example/stalls/cheese
https://railways.example/timetables/northern-line
https://airport.example/arrivals
https://chess.example.org/openings/queens-gambit
https://knitting.example/patterns/baby-blanket
https://running.example/training/first-marathon
https://football.example/fixtures/league-two
https://volleyball-verein.example/mannschaft/damen
https://philosophy.example.edu.example/entries/stoicism
https://linguistics.example/corpora/spoken
https://translation.example/glossary/legal-terms
https://dictionary.example/define/serendipity
https://genealogy.example/families/harrison
https://obituaries.example/2017/november
https://volunteer.example/opportunities/river-cleaning
https://charity.example.org/annual-report-2020.pdf
https://church.example/bulletin/advent
https://synagogue.example/calendar
https://mosque.example/lessons/friday
https://architecture.example/buildings/town-halls
https://photography.example/essays/harbour-at-dawn
https://pottery.example/glazes/celadon
https://energy.example/tariffs/compare-homes
https://water.example/quality/reports
https://insurance.example/claims/home
https://jobs.example/vacancies/nurse
https://careers.example.com/apply/teacher
https://housing.example/tenants/repairs
https://pets.example/dogs/first-aid
https://veterinary.example/advice/cats
https://gaertnerei.example/stauden
https://boulangerie.example/horaires
https://biblioteca.example/catalogo/novela
https://periodico.example/cultura/feria-del-libro
https://universidad.example/facultades/derecho
https://hospital.example/urgencias
https://ayuntamiento.example/tramites/padron
https://mairie.example/etat-civil
https://ecole.example/cantine
https://journal-local.example/faits/2020/11
https://verwaltung.example/formulare/anmeldung
https://zeitung.example/lokales/bruecke-gesperrt
https://verlag.example/buecher/neuerscheinungen
https://blog.example.com/en/10482
https://www.example.org/fr/22017.html
http://m.example.net/de/3341?page=2
https://sub.example.com/es/90012/
https://notes.example.net/en/771#top
https://www.harrow.example.org/en/5120?utm_source=feed
https://blog.thornton.example.com/en/88120.html
https://m.anders.example.net/fr/4410#top
http://weston.example.net/de/120?page=3&ref=x
https://theron.example.org/en/6612/
https://enseth.example.com/es/1200.html
https://tiller.example.net/en/30817
https://blog.ashworth.example.org/fr/100/
https://www.inger.example.com/de/5/
https://m.bleston.example.org/en/200417?utm_source=feed
""".split()

BLOCKED = """
https://www.luckyspin-casino.example/slots/mega-jackpot
https://casino-royal-bonus.example/welcome-offer?ref=aff12
http://m.grandcasino.example/live/roulette
https://online-casinos24.example/top-10
https://best-casino-wins.example/no-deposit
https://pokerstacks.example/tournaments/freeroll
http://www.play-poker-now.example/signup
https://texasholdem-poker.example/cash-games
https://sportsbets.example/football/odds
https://free-betting-tips.example/today
https://bet-and-win.example/live-odds?aff=77
https://www.bets4you.example/accumulator
https://freebets-offers.example/claim
https://slots-jackpot-wins.example/spin
https://bingo-cash.example/win-big
https://lottery-winners.example/claim-prize
https://lotto-win.example/results/you-won
https://win-iphone.example/prize/claim-now
https://spin2win.example/free-spins
https://gamble-online.example/bonus-code
https://xxx-videos.example/hd/18
http://free-xxx-tube.example/watch/88213
https://hot-porn-clips.example/amateur
https://pornhub-mirror.example/category/milf
https://sexcam-live.example/girls/online
https://www.adult-dating.example/hookup/near-you
https://adultchat.example/cams
https://nude-celebs.example/gallery/leaked
https://escort-service.example/city/tonight
https://escorts-vip.example/profiles
https://erotic-stories.example/new
https://hookup-tonight.example/join-free
https://milf-dates.example/signup
https://cam-girls.example/private-show
https://sexy-singles.example/chat-now
https://cheap-viagra.example/order/no-prescription
http://buy-cialis-online.example/generic
https://pills-discount.example/cart/add
https://canadian-pharmacy-meds.example/buy-cheap-pills
https://diet-pills.example/lose-weight-fast
https://weightloss-miracle.example/order-now
https://male-enhancement.example/free-trial
https://steroids-shop.example/buy
https://no-prescription-drugs.example/xanax
https://buy-tramadol.example/cheap
https://hair-loss-cure.example/miracle
https://payday-loans-fast.example/apply-now
https://instant-cash-loan.example/no-credit-check
https://cheap-loans.example/approve-me
https://quick-money.example/earn-from-home
https://make-money-fast.example/join
https://get-rich-crypto.example/double-your-bitcoin
https://bitcoin-doubler.example/invest
https://crypto-giveaway.example/claim-free-eth
https://forex-signals-profit.example/vip
https://binary-options.example/free-money
https://work-from-home-cash.example/start
https://cheap-replica-watches.example/rolex
https://replica-handbags.example/outlet-sale
https://cheap-jerseys.example/outlet
https://louis-outlet.example/cheap/bags-sale
https://torrent-files.example/download/movie-2023-1080p
http://thetorrentbay.example/search/album-flac
https://free-download-full.example/keygen
https://cracked-software.example/serial/photoshop
https://warez-forum.example/crack/office
https://keygens-cracks.example/download
https://mp3-free-download.example/top100
https://watch-movies-free.example/stream/full-hd
https://123-movies-stream.example/watch
https://free-streaming-hd.example/episode/1
https://apk-mod-hack.example/unlimited-coins
https://game-hacks.example/generator/free-gems
https://free-gems-generator.example/no-survey
https://clickads-network.example/redirect?to=offer
https://ads-popunder.example/go.php?id=99
https://traffic-exchange.example/earn-clicks
https://buy-followers.example/instagram/cheap
https://buy-likes-cheap.example/order
https://seo-backlinks.example/buy-links
https://cheap-seo-links.example/packages
https://bulk-email-list.example/buy
https://survey-rewards.example/gift-card/claim
https://free-gift-cards.example/claim-now
https://you-are-winner.example/prize
https://claim-your-prize.example/win
https://account-verify-login.example/secure/update-password
https://paypa1-security.example/verify/account
https://secure-bank-login.example/update/verify
https://login-verify-account.example/confirm
https://your-package-held.example/pay-fee
https://tax-refund-claim.example/verify
https://fortune-teller-love.example/spell-caster
https://love-spells.example/bring-back-ex
https://essay-writers-cheap.example/order-now
https://cheap-essays.example/buy
https://term-papers.example/buy-cheap
https://fake-diploma.example/buy-degree
https://fake-id.example/order
https://hacker-for-hire.example/order
https://phone-spy.example/track-now
https://m.casino-lucky.example.com/en/2210.html
https://www.free-casino.example.net/en/91#top
https://blog.win-bets.example.org/en/5522?utm_source=feed
https://poker-win.example.com/de/771/
http://xxx-cams.example.net/fr/882.html
https://cheap-pills.example.org/es/2207?page=2
https://free-slots.example.com/en/19
""".split()
