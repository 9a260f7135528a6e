"""Given names, their short forms and common surnames from which the names of a corpus are learned, replaced and linked.

These are seeds: fixed values from many languages. What else is a name in a corpus is learned from it (``pii.learn_names``).
f, m or n (either) is the gender a replacement keeps.
"""

GIVEN_NAMES = {
    "f": """Marta Amina Thandiwe Anaïs Zofia Ananya Fatima Priya Lucía Freya Mei Olga Inés Victoria Leila Susannah Chiara Josephine Zoë Margaret Ekaterina Noémie Elif Yuki Siobhan Patricia Ingrid Magdalena Gabriela Katherine Elizabeth Léa
        Mary Anna Anne Maria Sarah Emma Laura Linda Barbara Jennifer Susan Jessica Karen Nancy Lisa Sandra Ashley Kimberly Emily Donna Michelle Carol Amanda Melissa Deborah Stephanie Rebecca Sharon Cynthia Kathleen Amy Angela Helen Nicole Samantha Christine Rachel
        Julia Sophie Charlotte Hannah Claire Camille Isabelle Élodie Monika Petra Ursula Sabine Heike Katrin Lucia Carmen Pilar Elena Francesca Giulia Paola Beatriz Ana Joana Astrid Maja Kristina Agnieszka Aisha Zainab Layla Sakura Yuko Xiuying Sunita Lakshmi Ngozi Adaeze Wanjiru
        Анна Мария Елена Ольга Наталья Татьяна Екатерина Ирина Светлана Μαρία Ελένη Κατερίνα""".split(),
    "m": """Jonas Carlos Björn Søren Dmitri Guillermo Michael Arjun Rhys Piotr Chidi Richard Haruto Paolo Francisco Mehmet Kwame Anthony Yusuf Robert Benjamin Andrew Daniel Nicholas Omar Ewan Samuel William Jürgen Theodore Christopher Rahul Thomas Wei Johannes Edward Sebastian Alexander
        John James David Peter Paul Joseph Charles Matthew Donald Steven Kevin Brian George Kenneth Joshua Ronald Timothy Jason Jeffrey Ryan Gary Eric Stephen Jonathan Larry Justin Scott Brandon Gregory Raymond Patrick Alan Philip Martin Simon Oliver Henry Arthur
        Pierre Jean Luc François Étienne Antoine Olivier Hans Klaus Stefan Wolfgang Dieter Juan José Luis Miguel Javier Diego Pablo Marco Giovanni Luca Matteo João Pedro Lars Erik Nils Sven Jan Tomasz Krzysztof Mohammed Muhammad Ahmed Ali Hassan Ibrahim Khalid Hiroshi Takeshi Kenji Xiaoming Jianguo Rajesh Sanjay Vikram Chukwuemeka Kofi Kamau
        Иван Александр Сергей Дмитрий Алексей Андрей Михаил Николай Владимир Γιώργος Νίκος Δημήτρης""".split(),
}
SHORT_FORMS = {
    "Alexander": "Alex Sasha Sandy Lex Xander", "Andrew": "Andy Drew", "Anthony": "Tony", "Benjamin": "Ben Benny", "Christopher": "Chris Kit", "Daniel": "Dan Danny",
    "Dmitri": "Dima Mitya", "Edward": "Ed Eddie Ted Ned", "Ekaterina": "Katya Katia", "Elizabeth": "Liz Beth Betty Lizzie Eliza Libby", "Francisco": "Paco Pancho Fran", "Gabriela": "Gabi Gaby",
    "Guillermo": "Memo Guille", "Johannes": "Hans Hannes", "Josephine": "Jo Josie", "Katherine": "Kathy Kate Katie Kat", "Magdalena": "Magda Lena", "Margaret": "Maggie Peggy Meg Greta", "Michael": "Mike Mick Mickey",
    "Nicholas": "Nick Nicky", "Patricia": "Pat Patty Trish Tricia", "Richard": "Rick Dick Rich Richie", "Robert": "Bob Rob Bobby Robbie", "Samuel": "Sam Sammy", "Sebastian": "Seb Bas Basti", "Susannah": "Susie Sue Susan",
    "Theodore": "Theo Ted Teddy", "Thomas": "Tom Tommy", "Victoria": "Vicky Vicki Tori", "William": "Bill Will Billy Liam",
    "Joseph": "Joe Joey", "James": "Jim Jimmy", "David": "Dave Davy", "Jennifer": "Jenny Jen", "Rebecca": "Becky", "Stephen": "Steve", "Matthew": "Matt", "Jessica": "Jess", "Timothy": "Tim", "Gregory": "Greg", "Deborah": "Debbie", "Charles": "Charlie Chuck", "Kenneth": "Ken Kenny", "Philip": "Phil", "Jonathan": "Jon", "Joshua": "Josh",
}
#: Common surnames. Those of the second line often stand before the given name.
SURNAMES = set("""smith johnson williams brown jones miller davis wilson anderson taylor thomas moore jackson thompson martinez garcia rodriguez lopez gonzalez hernandez perez sanchez schmidt müller schneider fischer weber meyer wagner becker hoffmann dubois durand lefebvre moreau laurent rossi ferrari esposito bianchi silva santos oliveira pereira kowalski nowak jansen vries hansen nielsen andersson johansson khan singh sharma patel kumar gupta okafor mensah petrov ivanov sokolov popov петров иванов смирнов кузнецов попов соколов петрова иванова смирнова παπαδόπουλος""".split())
FAMILY_FIRST = set("wang zhang liu chen yang huang zhao zhou tanaka suzuki watanabe takahashi nguyen tran".split())
HAN_FAMILIES = "王李张張刘劉陈陳杨楊黄黃赵趙吴吳周徐孙孫马馬朱胡郭何林高罗羅郑鄭梁谢謝宋唐许許韩韓冯馮邓鄧曹彭曾"
TITLES = "Dr Prof Mr Mrs Ms Miss Herr Frau Madame Mme Monsieur Señor Señora Sra Sr Sir Dame Professor Doctor Signor Signora Doña Г-н Г-жа Господин Госпожа Доктор Профессор".split()
