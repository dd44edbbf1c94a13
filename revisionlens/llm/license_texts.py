"""Whole texts of long public licenses: their words in lower case, as ``licenses.words_at`` cuts them."""

TEXTS = {
    "Apache-2.0": """
apache license version 2 0 january 2004 http www apache org licenses terms and conditions for use reproduction and distribution 1 definitions license
shall mean the terms and conditions for use reproduction and distribution as defined by sections 1 through 9 of this document licensor shall mean the
copyright owner or entity authorized by the copyright owner that is granting the license legal entity shall mean the union of the acting entity and
all other entities that control are controlled by or are under common control with that entity for the purposes of this definition control means i the
power direct or indirect to cause the direction or management of such entity whether by contract or otherwise or ii ownership of fifty percent 50 or
more of the outstanding shares or iii beneficial ownership of such entity you or your shall mean an individual or legal entity exercising permissions
granted by this license source form shall mean the preferred form for making modifications including but not limited to software source code
documentation source and configuration files object form shall mean any form resulting from mechanical transformation or translation of a source form
including but not limited to compiled object code generated documentation and conversions to other media types work shall mean the work of authorship
whether in source or object form made available under the license as indicated by a copyright notice that is included in or attached to the work an
example is provided in the appendix below derivative works shall mean any work whether in source or object form that is based on or derived from the
work and for which the editorial revisions annotations elaborations or other modifications represent as a whole an original work of authorship for the
purposes of this license derivative works shall not include works that remain separable from or merely link or bind by name to the interfaces of the
work and derivative works thereof contribution shall mean any work of authorship including the original version of the work and any modifications or
additions to that work or derivative works thereof that is intentionally submitted to licensor for inclusion in the work by the copyright owner or by
an individual or legal entity authorized to submit on behalf of the copyright owner for the purposes of this definition submitted means any form of
electronic verbal or written communication sent to the licensor or its representatives including but not limited to communication on electronic
mailing lists source code control systems and issue tracking systems that are managed by or on behalf of the licensor for the purpose of discussing
and improving the work but excluding communication that is conspicuously marked or otherwise designated in writing by the copyright owner as not a
contribution contributor shall mean licensor and any individual or legal entity on behalf of whom a contribution has been received by licensor and
subsequently incorporated within the work 2 grant of copyright license subject to the terms and conditions of this license each contributor hereby
grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license to reproduce prepare derivative works of
publicly display publicly perform sublicense and distribute the work and such derivative works in source or object form 3 grant of patent license
subject to the terms and conditions of this license each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free
irrevocable except as stated in this section patent license to make have made use offer to sell sell import and otherwise transfer the work where such
license applies only to those patent claims licensable by such contributor that are necessarily infringed by their contribution s alone or by
combination of their contribution s with the work to which such contribution s was submitted if you institute patent litigation against any entity
including a cross claim or counterclaim in a lawsuit alleging that the work or a contribution incorporated within the work constitutes direct or
contributory patent infringement then any patent licenses granted to you under this license for that work shall terminate as of the date such
litigation is filed 4 redistribution you may reproduce and distribute copies of the work or derivative works thereof in any medium with or without
modifications and in source or object form provided that you meet the following conditions a you must give any other recipients of the work or
derivative works a copy of this license and b you must cause any modified files to carry prominent notices stating that you changed the files and c
you must retain in the source form of any derivative works that you distribute all copyright patent trademark and attribution notices from the source
form of the work excluding those notices that do not pertain to any part of the derivative works and d if the work includes a notice text file as part
of its distribution then any derivative works that you distribute must include a readable copy of the attribution notices contained within such notice
file excluding those notices that do not pertain to any part of the derivative works in at least one of the following places within a notice text file
distributed as part of the derivative works within the source form or documentation if provided along with the derivative works or within a display
generated by the derivative works if and wherever such third party notices normally appear the contents of the notice file are for informational
purposes only and do not modify the license you may add your own attribution notices within derivative works that you distribute alongside or as an
addendum to the notice text from the work provided that such additional attribution notices cannot be construed as modifying the license you may add
your own copyright statement to your modifications and may provide additional or different license terms and conditions for use reproduction or
distribution of your modifications or for any such derivative works as a whole provided your use reproduction and distribution of the work otherwise
complies with the conditions stated in this license 5 submission of contributions unless you explicitly state otherwise any contribution intentionally
submitted for inclusion in the work by you to the licensor shall be under the terms and conditions of this license without any additional terms or
conditions notwithstanding the above nothing herein shall supersede or modify the terms of any separate license agreement you may have executed with
licensor regarding such contributions 6 trademarks this license does not grant permission to use the trade names trademarks service marks or product
names of the licensor except as required for reasonable and customary use in describing the origin of the work and reproducing the content of the
notice file 7 disclaimer of warranty unless required by applicable law or agreed to in writing licensor provides the work and each contributor
provides its contributions on an as is basis without warranties or conditions of any kind either express or implied including without limitation any
warranties or conditions of title non infringement merchantability or fitness for a particular purpose you are solely responsible for determining the
appropriateness of using or redistributing the work and assume any risks associated with your exercise of permissions under this license 8 limitation
of liability in no event and under no legal theory whether in tort including negligence contract or otherwise unless required by applicable law such
as deliberate and grossly negligent acts or agreed to in writing shall any contributor be liable to you for damages including any direct indirect
special incidental or consequential damages of any character arising as a result of this license or out of the use or inability to use the work
including but not limited to damages for loss of goodwill work stoppage computer failure or malfunction or any and all other commercial damages or
losses even if such contributor has been advised of the possibility of such damages 9 accepting warranty or additional liability while redistributing
the work or derivative works thereof you may choose to offer and charge a fee for acceptance of support warranty indemnity or other liability
obligations and or rights consistent with this license however in accepting such obligations you may act only on your own behalf and on your sole
responsibility not on behalf of any other contributor and only if you agree to indemnify defend and hold each contributor harmless for any liability
incurred by or claims asserted against such contributor by reason of your accepting any such warranty or additional liability end of terms and
conditions appendix how to apply the apache license to your work to apply the apache license to your work attach the following boilerplate notice with
the fields enclosed by brackets replaced with your own identifying information don t include the brackets the text should be enclosed in the
appropriate comment syntax for the file format we also recommend that a file or class name and description of purpose be included on the same printed
page as the copyright notice for easier identification within third party archives copyright yyyy name of copyright owner licensed under the apache
license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www
apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an
as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and
limitations under the license""",
    "Artistic-1.0": """
the artistic license preamble the intent of this document is to state the conditions under which a package may be copied such that the copyright
holder maintains some semblance of artistic control over the development of the package while giving the users of the package the right to use and
distribute the package in a more or less customary fashion plus the right to make reasonable modifications definitions package refers to the
collection of files distributed by the copyright holder and derivatives of that collection of files created through textual modification standard
version refers to such a package if it has not been modified or has been modified in accordance with the wishes of the copyright holder as specified
below copyright holder is whoever is named in the copyright or copyrights for the package you is you if you re thinking about copying or distributing
this package reasonable copying fee is whatever you can justify on the basis of media cost duplication charges time of people involved and so on you
will not be required to justify it to the copyright holder but only to the computing community at large as a market that must bear the fee freely
available means that no fee is charged for the item itself though there may be fees involved in handling the item it also means that recipients of the
item may redistribute it under the same conditions they received it 1 you may make and give away verbatim copies of the source form of the standard
version of this package without restriction provided that you duplicate all of the original copyright notices and associated disclaimers 2 you may
apply bug fixes portability fixes and other modifications derived from the public domain or from the copyright holder a package modified in such a way
shall still be considered the standard version 3 you may otherwise modify your copy of this package in any way provided that you insert a prominent
notice in each changed file stating how and when you changed that file and provided that you do at least one of the following a place your
modifications in the public domain or otherwise make them freely available such as by posting said modifications to usenet or an equivalent medium or
placing the modifications on a major archive site such as uunet uu net or by allowing the copyright holder to include your modifications in the
standard version of the package b use the modified package only within your corporation or organization c rename any non standard executables so the
names do not conflict with standard executables which must also be provided and provide a separate manual page for each non standard executable that
clearly documents how it differs from the standard version d make other distribution arrangements with the copyright holder 4 you may distribute the
programs of this package in object code or executable form provided that you do at least one of the following a distribute a standard version of the
executables and library files together with instructions in the manual page or equivalent on where to get the standard version b accompany the
distribution with the machine readable source of the package with your modifications c give non standard executables non standard names and clearly
document the differences in manual pages or equivalent together with instructions on where to get the standard version d make other distribution
arrangements with the copyright holder 5 you may charge a reasonable copying fee for any distribution of this package you may charge any fee you
choose for support of this package you may not charge a fee for this package itself however you may distribute this package in aggregate with other
possibly commercial programs as part of a larger possibly commercial software distribution provided that you do not advertise this package as a
product of your own you may embed this package s interpreter within an executable of yours by linking this shall be construed as a mere form of
aggregation provided that the complete standard version of the interpreter is so embedded 6 the scripts and library files supplied as input to or
produced as output from the programs of this package do not automatically fall under the copyright of this package but belong to whoever generated
them and may be sold commercially and may be aggregated with this package if such scripts or library files are aggregated with this package via the so
called undump or unexec methods of producing a binary executable image then distribution of such an image shall neither be construed as a distribution
of this package nor shall it fall under the restrictions of paragraphs 3 and 4 provided that you do not represent such an executable image as a
standard version of this package 7 c subroutines or comparably compiled subroutines in other languages supplied by you and linked into this package in
order to emulate subroutines and variables of the language defined by this package shall not be considered part of this package but are the equivalent
of input as in paragraph 6 provided these subroutines do not change the language in any way that would cause it to fail the regression tests for the
language 8 aggregation of this package with a commercial distribution is always permitted provided that the use of this package is embedded that is
when no overt attempt is made to make this package s interfaces visible to the end user of the commercial distribution such use shall not be construed
as a distribution of this package 9 the name of the copyright holder may not be used to endorse or promote products derived from this software without
specific prior written permission 10 this package is provided as is and without any express or implied warranties including without limitation the
implied warranties of merchantibility and fitness for a particular purpose the end""",
    "CC0-1.0": """
creative commons legal code cc0 1 0 universal creative commons corporation is not a law firm and does not provide legal services distribution of this
document does not create an attorney client relationship creative commons provides this information on an as is basis creative commons makes no
warranties regarding the use of this document or the information or works provided hereunder and disclaims liability for damages resulting from the
use of this document or the information or works provided hereunder statement of purpose the laws of most jurisdictions throughout the world
automatically confer exclusive copyright and related rights defined below upon the creator and subsequent owner s each and all an owner of an original
work of authorship and or a database each a work certain owners wish to permanently relinquish those rights to a work for the purpose of contributing
to a commons of creative cultural and scientific works commons that the public can reliably and without fear of later claims of infringement build
upon modify incorporate in other works reuse and redistribute as freely as possible in any form whatsoever and for any purposes including without
limitation commercial purposes these owners may contribute to the commons to promote the ideal of a free culture and the further production of
creative cultural and scientific works or to gain reputation or greater distribution for their work in part through the use and efforts of others for
these and or other purposes and motivations and without any expectation of additional consideration or compensation the person associating cc0 with a
work the affirmer to the extent that he or she is an owner of copyright and related rights in the work voluntarily elects to apply cc0 to the work and
publicly distribute the work under its terms with knowledge of his or her copyright and related rights in the work and the meaning and intended legal
effect of cc0 on those rights 1 copyright and related rights a work made available under cc0 may be protected by copyright and related or neighboring
rights copyright and related rights copyright and related rights include but are not limited to the following i the right to reproduce adapt
distribute perform display communicate and translate a work ii moral rights retained by the original author s and or performer s iii publicity and
privacy rights pertaining to a person s image or likeness depicted in a work iv rights protecting against unfair competition in regards to a work
subject to the limitations in paragraph 4 a below v rights protecting the extraction dissemination use and reuse of data in a work vi database rights
such as those arising under directive 96 9 ec of the european parliament and of the council of 11 march 1996 on the legal protection of databases and
under any national implementation thereof including any amended or successor version of such directive and vii other similar equivalent or
corresponding rights throughout the world based on applicable law or treaty and any national implementations thereof 2 waiver to the greatest extent
permitted by but not in contravention of applicable law affirmer hereby overtly fully permanently irrevocably and unconditionally waives abandons and
surrenders all of affirmer s copyright and related rights and associated claims and causes of action whether now known or unknown including existing
as well as future claims and causes of action in the work i in all territories worldwide ii for the maximum duration provided by applicable law or
treaty including future time extensions iii in any current or future medium and for any number of copies and iv for any purpose whatsoever including
without limitation commercial advertising or promotional purposes the waiver affirmer makes the waiver for the benefit of each member of the public at
large and to the detriment of affirmer s heirs and successors fully intending that such waiver shall not be subject to revocation rescission
cancellation termination or any other legal or equitable action to disrupt the quiet enjoyment of the work by the public as contemplated by affirmer s
express statement of purpose 3 public license fallback should any part of the waiver for any reason be judged legally invalid or ineffective under
applicable law then the waiver shall be preserved to the maximum extent permitted taking into account affirmer s express statement of purpose in
addition to the extent the waiver is so judged affirmer hereby grants to each affected person a royalty free non transferable non sublicensable non
exclusive irrevocable and unconditional license to exercise affirmer s copyright and related rights in the work i in all territories worldwide ii for
the maximum duration provided by applicable law or treaty including future time extensions iii in any current or future medium and for any number of
copies and iv for any purpose whatsoever including without limitation commercial advertising or promotional purposes the license the license shall be
deemed effective as of the date cc0 was applied by affirmer to the work should any part of the license for any reason be judged legally invalid or
ineffective under applicable law such partial invalidity or ineffectiveness shall not invalidate the remainder of the license and in such case
affirmer hereby affirms that he or she will not i exercise any of his or her remaining copyright and related rights in the work or ii assert any
associated claims and causes of action with respect to the work in either case contrary to affirmer s express statement of purpose 4 limitations and
disclaimers a no trademark or patent rights held by affirmer are waived abandoned surrendered licensed or otherwise affected by this document b
affirmer offers the work as is and makes no representations or warranties of any kind concerning the work express implied statutory or otherwise
including without limitation warranties of title merchantability fitness for a particular purpose non infringement or the absence of latent or other
defects accuracy or the present or absence of errors whether or not discoverable all to the greatest extent permissible under applicable law c
affirmer disclaims responsibility for clearing rights of other persons that may apply to the work or any use thereof including without limitation any
person s copyright and related rights in the work further affirmer disclaims responsibility for obtaining any necessary consents permissions or other
rights required for any use of the work d affirmer understands and acknowledges that creative commons is not a party to this document and has no duty
or obligation with respect to this cc0 or use of the work""",
    "GFDL-1.2": """
gnu free documentation license version 1 2 november 2002 copyright c 2000 2001 2002 free software foundation inc 51 franklin st fifth floor boston ma
02110 1301 usa everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed 0 preamble the
purpose of this license is to make a manual textbook or other functional and useful document free in the sense of freedom to assure everyone the
effective freedom to copy and redistribute it with or without modifying it either commercially or noncommercially secondarily this license preserves
for the author and publisher a way to get credit for their work while not being considered responsible for modifications made by others this license
is a kind of copyleft which means that derivative works of the document must themselves be free in the same sense it complements the gnu general
public license which is a copyleft license designed for free software we have designed this license in order to use it for manuals for free software
because free software needs free documentation a free program should come with manuals providing the same freedoms that the software does but this
license is not limited to software manuals it can be used for any textual work regardless of subject matter or whether it is published as a printed
book we recommend this license principally for works whose purpose is instruction or reference 1 applicability and definitions this license applies to
any manual or other work in any medium that contains a notice placed by the copyright holder saying it can be distributed under the terms of this
license such a notice grants a world wide royalty free license unlimited in duration to use that work under the conditions stated herein the document
below refers to any such manual or work any member of the public is a licensee and is addressed as you you accept the license if you copy modify or
distribute the work in a way requiring permission under copyright law a modified version of the document means any work containing the document or a
portion of it either copied verbatim or with modifications and or translated into another language a secondary section is a named appendix or a front
matter section of the document that deals exclusively with the relationship of the publishers or authors of the document to the document s overall
subject or to related matters and contains nothing that could fall directly within that overall subject thus if the document is in part a textbook of
mathematics a secondary section may not explain any mathematics the relationship could be a matter of historical connection with the subject or with
related matters or of legal commercial philosophical ethical or political position regarding them the invariant sections are certain secondary
sections whose titles are designated as being those of invariant sections in the notice that says that the document is released under this license if
a section does not fit the above definition of secondary then it is not allowed to be designated as invariant the document may contain zero invariant
sections if the document does not identify any invariant sections then there are none the cover texts are certain short passages of text that are
listed as front cover texts or back cover texts in the notice that says that the document is released under this license a front cover text may be at
most 5 words and a back cover text may be at most 25 words a transparent copy of the document means a machine readable copy represented in a format
whose specification is available to the general public that is suitable for revising the document straightforwardly with generic text editors or for
images composed of pixels generic paint programs or for drawings some widely available drawing editor and that is suitable for input to text
formatters or for automatic translation to a variety of formats suitable for input to text formatters a copy made in an otherwise transparent file
format whose markup or absence of markup has been arranged to thwart or discourage subsequent modification by readers is not transparent an image
format is not transparent if used for any substantial amount of text a copy that is not transparent is called opaque examples of suitable formats for
transparent copies include plain ascii without markup texinfo input format latex input format sgml or xml using a publicly available dtd and standard
conforming simple html postscript or pdf designed for human modification examples of transparent image formats include png xcf and jpg opaque formats
include proprietary formats that can be read and edited only by proprietary word processors sgml or xml for which the dtd and or processing tools are
not generally available and the machine generated html postscript or pdf produced by some word processors for output purposes only the title page
means for a printed book the title page itself plus such following pages as are needed to hold legibly the material this license requires to appear in
the title page for works in formats which do not have any title page as such title page means the text near the most prominent appearance of the work
s title preceding the beginning of the body of the text a section entitled xyz means a named subunit of the document whose title either is precisely
xyz or contains xyz in parentheses following text that translates xyz in another language here xyz stands for a specific section name mentioned below
such as acknowledgements dedications endorsements or history to preserve the title of such a section when you modify the document means that it
remains a section entitled xyz according to this definition the document may include warranty disclaimers next to the notice which states that this
license applies to the document these warranty disclaimers are considered to be included by reference in this license but only as regards disclaiming
warranties any other implication that these warranty disclaimers may have is void and has no effect on the meaning of this license 2 verbatim copying
you may copy and distribute the document in any medium either commercially or noncommercially provided that this license the copyright notices and the
license notice saying this license applies to the document are reproduced in all copies and that you add no other conditions whatsoever to those of
this license you may not use technical measures to obstruct or control the reading or further copying of the copies you make or distribute however you
may accept compensation in exchange for copies if you distribute a large enough number of copies you must also follow the conditions in section 3 you
may also lend copies under the same conditions stated above and you may publicly display copies 3 copying in quantity if you publish printed copies or
copies in media that commonly have printed covers of the document numbering more than 100 and the document s license notice requires cover texts you
must enclose the copies in covers that carry clearly and legibly all these cover texts front cover texts on the front cover and back cover texts on
the back cover both covers must also clearly and legibly identify you as the publisher of these copies the front cover must present the full title
with all words of the title equally prominent and visible you may add other material on the covers in addition copying with changes limited to the
covers as long as they preserve the title of the document and satisfy these conditions can be treated as verbatim copying in other respects if the
required texts for either cover are too voluminous to fit legibly you should put the first ones listed as many as fit reasonably on the actual cover
and continue the rest onto adjacent pages if you publish or distribute opaque copies of the document numbering more than 100 you must either include a
machine readable transparent copy along with each opaque copy or state in or with each opaque copy a computer network location from which the general
network using public has access to download using public standard network protocols a complete transparent copy of the document free of added material
if you use the latter option you must take reasonably prudent steps when you begin distribution of opaque copies in quantity to ensure that this
transparent copy will remain thus accessible at the stated location until at least one year after the last time you distribute an opaque copy directly
or through your agents or retailers of that edition to the public it is requested but not required that you contact the authors of the document well
before redistributing any large number of copies to give them a chance to provide you with an updated version of the document 4 modifications you may
copy and distribute a modified version of the document under the conditions of sections 2 and 3 above provided that you release the modified version
under precisely this license with the modified version filling the role of the document thus licensing distribution and modification of the modified
version to whoever possesses a copy of it in addition you must do these things in the modified version a use in the title page and on the covers if
any a title distinct from that of the document and from those of previous versions which should if there were any be listed in the history section of
the document you may use the same title as a previous version if the original publisher of that version gives permission b list on the title page as
authors one or more persons or entities responsible for authorship of the modifications in the modified version together with at least five of the
principal authors of the document all of its principal authors if it has fewer than five unless they release you from this requirement c state on the
title page the name of the publisher of the modified version as the publisher d preserve all the copyright notices of the document e add an
appropriate copyright notice for your modifications adjacent to the other copyright notices f include immediately after the copyright notices a
license notice giving the public permission to use the modified version under the terms of this license in the form shown in the addendum below g
preserve in that license notice the full lists of invariant sections and required cover texts given in the document s license notice h include an
unaltered copy of this license i preserve the section entitled history preserve its title and add to it an item stating at least the title year new
authors and publisher of the modified version as given on the title page if there is no section entitled history in the document create one stating
the title year authors and publisher of the document as given on its title page then add an item describing the modified version as stated in the
previous sentence j preserve the network location if any given in the document for public access to a transparent copy of the document and likewise
the network locations given in the document for previous versions it was based on these may be placed in the history section you may omit a network
location for a work that was published at least four years before the document itself or if the original publisher of the version it refers to gives
permission k for any section entitled acknowledgements or dedications preserve the title of the section and preserve in the section all the substance
and tone of each of the contributor acknowledgements and or dedications given therein l preserve all the invariant sections of the document unaltered
in their text and in their titles section numbers or the equivalent are not considered part of the section titles m delete any section entitled
endorsements such a section may not be included in the modified version n do not retitle any existing section to be entitled endorsements or to
conflict in title with any invariant section o preserve any warranty disclaimers if the modified version includes new front matter sections or
appendices that qualify as secondary sections and contain no material copied from the document you may at your option designate some or all of these
sections as invariant to do this add their titles to the list of invariant sections in the modified version s license notice these titles must be
distinct from any other section titles you may add a section entitled endorsements provided it contains nothing but endorsements of your modified
version by various parties for example statements of peer review or that the text has been approved by an organization as the authoritative definition
of a standard you may add a passage of up to five words as a front cover text and a passage of up to 25 words as a back cover text to the end of the
list of cover texts in the modified version only one passage of front cover text and one of back cover text may be added by or through arrangements
made by any one entity if the document already includes a cover text for the same cover previously added by you or by arrangement made by the same
entity you are acting on behalf of you may not add another but you may replace the old one on explicit permission from the previous publisher that
added the old one the author s and publisher s of the document do not by this license give permission to use their names for publicity for or to
assert or imply endorsement of any modified version 5 combining documents you may combine the document with other documents released under this
license under the terms defined in section 4 above for modified versions provided that you include in the combination all of the invariant sections of
all of the original documents unmodified and list them all as invariant sections of your combined work in its license notice and that you preserve all
their warranty disclaimers the combined work need only contain one copy of this license and multiple identical invariant sections may be replaced with
a single copy if there are multiple invariant sections with the same name but different contents make the title of each such section unique by adding
at the end of it in parentheses the name of the original author or publisher of that section if known or else a unique number make the same adjustment
to the section titles in the list of invariant sections in the license notice of the combined work in the combination you must combine any sections
entitled history in the various original documents forming one section entitled history likewise combine any sections entitled acknowledgements and
any sections entitled dedications you must delete all sections entitled endorsements 6 collections of documents you may make a collection consisting
of the document and other documents released under this license and replace the individual copies of this license in the various documents with a
single copy that is included in the collection provided that you follow the rules of this license for verbatim copying of each of the documents in all
other respects you may extract a single document from such a collection and distribute it individually under this license provided you insert a copy
of this license into the extracted document and follow this license in all other respects regarding verbatim copying of that document 7 aggregation
with independent works a compilation of the document or its derivatives with other separate and independent documents or works in or on a volume of a
storage or distribution medium is called an aggregate if the copyright resulting from the compilation is not used to limit the legal rights of the
compilation s users beyond what the individual works permit when the document is included in an aggregate this license does not apply to the other
works in the aggregate which are not themselves derivative works of the document if the cover text requirement of section 3 is applicable to these
copies of the document then if the document is less than one half of the entire aggregate the document s cover texts may be placed on covers that
bracket the document within the aggregate or the electronic equivalent of covers if the document is in electronic form otherwise they must appear on
printed covers that bracket the whole aggregate 8 translation translation is considered a kind of modification so you may distribute translations of
the document under the terms of section 4 replacing invariant sections with translations requires special permission from their copyright holders but
you may include translations of some or all invariant sections in addition to the original versions of these invariant sections you may include a
translation of this license and all the license notices in the document and any warranty disclaimers provided that you also include the original
english version of this license and the original versions of those notices and disclaimers in case of a disagreement between the translation and the
original version of this license or a notice or disclaimer the original version will prevail if a section in the document is entitled acknowledgements
dedications or history the requirement section 4 to preserve its title section 1 will typically require changing the actual title 9 termination you
may not copy modify sublicense or distribute the document except as expressly provided for under this license any other attempt to copy modify
sublicense or distribute the document is void and will automatically terminate your rights under this license however parties who have received copies
or rights from you under this license will not have their licenses terminated so long as such parties remain in full compliance 10 future revisions of
this license the free software foundation may publish new revised versions of the gnu free documentation license from time to time such new versions
will be similar in spirit to the present version but may differ in detail to address new problems or concerns see https www gnu org licenses each
version of the license is given a distinguishing version number if the document specifies that a particular numbered version of this license or any
later version applies to it you have the option of following the terms and conditions either of that specified version or of any later version that
has been published not as a draft by the free software foundation if the document does not specify a version number of this license you may choose any
version ever published not as a draft by the free software foundation addendum how to use this license for your documents to use this license in a
document you have written include a copy of the license in the document and put the following copyright and license notices just after the title page
copyright c year your name permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license
version 1 2 or any later version published by the free software foundation with no invariant sections no front cover texts and no back cover texts a
copy of the license is included in the section entitled gnu free documentation license if you have invariant sections front cover texts and back cover
texts replace the with texts line with this with the invariant sections being list their titles with the front cover texts being list and with the
back cover texts being list if you have invariant sections without cover texts or some other combination of the three merge those two alternatives to
suit the situation if your document contains nontrivial examples of program code we recommend releasing these examples in parallel under your choice
of free software license such as the gnu general public license to permit their use in free software""",
    "GFDL-1.3": """
gnu free documentation license version 1 3 3 november 2008 copyright c 2000 2001 2002 2007 2008 free software foundation inc https fsf org everyone is
permitted to copy and distribute verbatim copies of this license document but changing it is not allowed 0 preamble the purpose of this license is to
make a manual textbook or other functional and useful document free in the sense of freedom to assure everyone the effective freedom to copy and
redistribute it with or without modifying it either commercially or noncommercially secondarily this license preserves for the author and publisher a
way to get credit for their work while not being considered responsible for modifications made by others this license is a kind of copyleft which
means that derivative works of the document must themselves be free in the same sense it complements the gnu general public license which is a
copyleft license designed for free software we have designed this license in order to use it for manuals for free software because free software needs
free documentation a free program should come with manuals providing the same freedoms that the software does but this license is not limited to
software manuals it can be used for any textual work regardless of subject matter or whether it is published as a printed book we recommend this
license principally for works whose purpose is instruction or reference 1 applicability and definitions this license applies to any manual or other
work in any medium that contains a notice placed by the copyright holder saying it can be distributed under the terms of this license such a notice
grants a world wide royalty free license unlimited in duration to use that work under the conditions stated herein the document below refers to any
such manual or work any member of the public is a licensee and is addressed as you you accept the license if you copy modify or distribute the work in
a way requiring permission under copyright law a modified version of the document means any work containing the document or a portion of it either
copied verbatim or with modifications and or translated into another language a secondary section is a named appendix or a front matter section of the
document that deals exclusively with the relationship of the publishers or authors of the document to the document s overall subject or to related
matters and contains nothing that could fall directly within that overall subject thus if the document is in part a textbook of mathematics a
secondary section may not explain any mathematics the relationship could be a matter of historical connection with the subject or with related matters
or of legal commercial philosophical ethical or political position regarding them the invariant sections are certain secondary sections whose titles
are designated as being those of invariant sections in the notice that says that the document is released under this license if a section does not fit
the above definition of secondary then it is not allowed to be designated as invariant the document may contain zero invariant sections if the
document does not identify any invariant sections then there are none the cover texts are certain short passages of text that are listed as front
cover texts or back cover texts in the notice that says that the document is released under this license a front cover text may be at most 5 words and
a back cover text may be at most 25 words a transparent copy of the document means a machine readable copy represented in a format whose specification
is available to the general public that is suitable for revising the document straightforwardly with generic text editors or for images composed of
pixels generic paint programs or for drawings some widely available drawing editor and that is suitable for input to text formatters or for automatic
translation to a variety of formats suitable for input to text formatters a copy made in an otherwise transparent file format whose markup or absence
of markup has been arranged to thwart or discourage subsequent modification by readers is not transparent an image format is not transparent if used
for any substantial amount of text a copy that is not transparent is called opaque examples of suitable formats for transparent copies include plain
ascii without markup texinfo input format latex input format sgml or xml using a publicly available dtd and standard conforming simple html postscript
or pdf designed for human modification examples of transparent image formats include png xcf and jpg opaque formats include proprietary formats that
can be read and edited only by proprietary word processors sgml or xml for which the dtd and or processing tools are not generally available and the
machine generated html postscript or pdf produced by some word processors for output purposes only the title page means for a printed book the title
page itself plus such following pages as are needed to hold legibly the material this license requires to appear in the title page for works in
formats which do not have any title page as such title page means the text near the most prominent appearance of the work s title preceding the
beginning of the body of the text the publisher means any person or entity that distributes copies of the document to the public a section entitled
xyz means a named subunit of the document whose title either is precisely xyz or contains xyz in parentheses following text that translates xyz in
another language here xyz stands for a specific section name mentioned below such as acknowledgements dedications endorsements or history to preserve
the title of such a section when you modify the document means that it remains a section entitled xyz according to this definition the document may
include warranty disclaimers next to the notice which states that this license applies to the document these warranty disclaimers are considered to be
included by reference in this license but only as regards disclaiming warranties any other implication that these warranty disclaimers may have is
void and has no effect on the meaning of this license 2 verbatim copying you may copy and distribute the document in any medium either commercially or
noncommercially provided that this license the copyright notices and the license notice saying this license applies to the document are reproduced in
all copies and that you add no other conditions whatsoever to those of this license you may not use technical measures to obstruct or control the
reading or further copying of the copies you make or distribute however you may accept compensation in exchange for copies if you distribute a large
enough number of copies you must also follow the conditions in section 3 you may also lend copies under the same conditions stated above and you may
publicly display copies 3 copying in quantity if you publish printed copies or copies in media that commonly have printed covers of the document
numbering more than 100 and the document s license notice requires cover texts you must enclose the copies in covers that carry clearly and legibly
all these cover texts front cover texts on the front cover and back cover texts on the back cover both covers must also clearly and legibly identify
you as the publisher of these copies the front cover must present the full title with all words of the title equally prominent and visible you may add
other material on the covers in addition copying with changes limited to the covers as long as they preserve the title of the document and satisfy
these conditions can be treated as verbatim copying in other respects if the required texts for either cover are too voluminous to fit legibly you
should put the first ones listed as many as fit reasonably on the actual cover and continue the rest onto adjacent pages if you publish or distribute
opaque copies of the document numbering more than 100 you must either include a machine readable transparent copy along with each opaque copy or state
in or with each opaque copy a computer network location from which the general network using public has access to download using public standard
network protocols a complete transparent copy of the document free of added material if you use the latter option you must take reasonably prudent
steps when you begin distribution of opaque copies in quantity to ensure that this transparent copy will remain thus accessible at the stated location
until at least one year after the last time you distribute an opaque copy directly or through your agents or retailers of that edition to the public
it is requested but not required that you contact the authors of the document well before redistributing any large number of copies to give them a
chance to provide you with an updated version of the document 4 modifications you may copy and distribute a modified version of the document under the
conditions of sections 2 and 3 above provided that you release the modified version under precisely this license with the modified version filling the
role of the document thus licensing distribution and modification of the modified version to whoever possesses a copy of it in addition you must do
these things in the modified version a use in the title page and on the covers if any a title distinct from that of the document and from those of
previous versions which should if there were any be listed in the history section of the document you may use the same title as a previous version if
the original publisher of that version gives permission b list on the title page as authors one or more persons or entities responsible for authorship
of the modifications in the modified version together with at least five of the principal authors of the document all of its principal authors if it
has fewer than five unless they release you from this requirement c state on the title page the name of the publisher of the modified version as the
publisher d preserve all the copyright notices of the document e add an appropriate copyright notice for your modifications adjacent to the other
copyright notices f include immediately after the copyright notices a license notice giving the public permission to use the modified version under
the terms of this license in the form shown in the addendum below g preserve in that license notice the full lists of invariant sections and required
cover texts given in the document s license notice h include an unaltered copy of this license i preserve the section entitled history preserve its
title and add to it an item stating at least the title year new authors and publisher of the modified version as given on the title page if there is
no section entitled history in the document create one stating the title year authors and publisher of the document as given on its title page then
add an item describing the modified version as stated in the previous sentence j preserve the network location if any given in the document for public
access to a transparent copy of the document and likewise the network locations given in the document for previous versions it was based on these may
be placed in the history section you may omit a network location for a work that was published at least four years before the document itself or if
the original publisher of the version it refers to gives permission k for any section entitled acknowledgements or dedications preserve the title of
the section and preserve in the section all the substance and tone of each of the contributor acknowledgements and or dedications given therein l
preserve all the invariant sections of the document unaltered in their text and in their titles section numbers or the equivalent are not considered
part of the section titles m delete any section entitled endorsements such a section may not be included in the modified version n do not retitle any
existing section to be entitled endorsements or to conflict in title with any invariant section o preserve any warranty disclaimers if the modified
version includes new front matter sections or appendices that qualify as secondary sections and contain no material copied from the document you may
at your option designate some or all of these sections as invariant to do this add their titles to the list of invariant sections in the modified
version s license notice these titles must be distinct from any other section titles you may add a section entitled endorsements provided it contains
nothing but endorsements of your modified version by various parties for example statements of peer review or that the text has been approved by an
organization as the authoritative definition of a standard you may add a passage of up to five words as a front cover text and a passage of up to 25
words as a back cover text to the end of the list of cover texts in the modified version only one passage of front cover text and one of back cover
text may be added by or through arrangements made by any one entity if the document already includes a cover text for the same cover previously added
by you or by arrangement made by the same entity you are acting on behalf of you may not add another but you may replace the old one on explicit
permission from the previous publisher that added the old one the author s and publisher s of the document do not by this license give permission to
use their names for publicity for or to assert or imply endorsement of any modified version 5 combining documents you may combine the document with
other documents released under this license under the terms defined in section 4 above for modified versions provided that you include in the
combination all of the invariant sections of all of the original documents unmodified and list them all as invariant sections of your combined work in
its license notice and that you preserve all their warranty disclaimers the combined work need only contain one copy of this license and multiple
identical invariant sections may be replaced with a single copy if there are multiple invariant sections with the same name but different contents
make the title of each such section unique by adding at the end of it in parentheses the name of the original author or publisher of that section if
known or else a unique number make the same adjustment to the section titles in the list of invariant sections in the license notice of the combined
work in the combination you must combine any sections entitled history in the various original documents forming one section entitled history likewise
combine any sections entitled acknowledgements and any sections entitled dedications you must delete all sections entitled endorsements 6 collections
of documents you may make a collection consisting of the document and other documents released under this license and replace the individual copies of
this license in the various documents with a single copy that is included in the collection provided that you follow the rules of this license for
verbatim copying of each of the documents in all other respects you may extract a single document from such a collection and distribute it
individually under this license provided you insert a copy of this license into the extracted document and follow this license in all other respects
regarding verbatim copying of that document 7 aggregation with independent works a compilation of the document or its derivatives with other separate
and independent documents or works in or on a volume of a storage or distribution medium is called an aggregate if the copyright resulting from the
compilation is not used to limit the legal rights of the compilation s users beyond what the individual works permit when the document is included in
an aggregate this license does not apply to the other works in the aggregate which are not themselves derivative works of the document if the cover
text requirement of section 3 is applicable to these copies of the document then if the document is less than one half of the entire aggregate the
document s cover texts may be placed on covers that bracket the document within the aggregate or the electronic equivalent of covers if the document
is in electronic form otherwise they must appear on printed covers that bracket the whole aggregate 8 translation translation is considered a kind of
modification so you may distribute translations of the document under the terms of section 4 replacing invariant sections with translations requires
special permission from their copyright holders but you may include translations of some or all invariant sections in addition to the original
versions of these invariant sections you may include a translation of this license and all the license notices in the document and any warranty
disclaimers provided that you also include the original english version of this license and the original versions of those notices and disclaimers in
case of a disagreement between the translation and the original version of this license or a notice or disclaimer the original version will prevail if
a section in the document is entitled acknowledgements dedications or history the requirement section 4 to preserve its title section 1 will typically
require changing the actual title 9 termination you may not copy modify sublicense or distribute the document except as expressly provided under this
license any attempt otherwise to copy modify sublicense or distribute it is void and will automatically terminate your rights under this license
however if you cease all violation of this license then your license from a particular copyright holder is reinstated a provisionally unless and until
the copyright holder explicitly and finally terminates your license and b permanently if the copyright holder fails to notify you of the violation by
some reasonable means prior to 60 days after the cessation moreover your license from a particular copyright holder is reinstated permanently if the
copyright holder notifies you of the violation by some reasonable means this is the first time you have received notice of violation of this license
for any work from that copyright holder and you cure the violation prior to 30 days after your receipt of the notice termination of your rights under
this section does not terminate the licenses of parties who have received copies or rights from you under this license if your rights have been
terminated and not permanently reinstated receipt of a copy of some or all of the same material does not give you any rights to use it 10 future
revisions of this license the free software foundation may publish new revised versions of the gnu free documentation license from time to time such
new versions will be similar in spirit to the present version but may differ in detail to address new problems or concerns see https www gnu org
licenses each version of the license is given a distinguishing version number if the document specifies that a particular numbered version of this
license or any later version applies to it you have the option of following the terms and conditions either of that specified version or of any later
version that has been published not as a draft by the free software foundation if the document does not specify a version number of this license you
may choose any version ever published not as a draft by the free software foundation if the document specifies that a proxy can decide which future
versions of this license can be used that proxy s public statement of acceptance of a version permanently authorizes you to choose that version for
the document 11 relicensing massive multiauthor collaboration site or mmc site means any world wide web server that publishes copyrightable works and
also provides prominent facilities for anybody to edit those works a public wiki that anybody can edit is an example of such a server a massive
multiauthor collaboration or mmc contained in the site means any set of copyrightable works thus published on the mmc site cc by sa means the creative
commons attribution share alike 3 0 license published by creative commons corporation a not for profit corporation with a principal place of business
in san francisco california as well as future copyleft versions of that license published by that same organization incorporate means to publish or
republish a document in whole or in part as part of another document an mmc is eligible for relicensing if it is licensed under this license and if
all works that were first published under this license somewhere other than this mmc and subsequently incorporated in whole or in part into the mmc 1
had no cover texts or invariant sections and 2 were thus incorporated prior to november 1 2008 the operator of an mmc site may republish an mmc
contained in the site under cc by sa on the same site at any time before august 1 2009 provided the mmc is eligible for relicensing addendum how to
use this license for your documents to use this license in a document you have written include a copy of the license in the document and put the
following copyright and license notices just after the title page copyright c year your name permission is granted to copy distribute and or modify
this document under the terms of the gnu free documentation license version 1 3 or any later version published by the free software foundation with no
invariant sections no front cover texts and no back cover texts a copy of the license is included in the section entitled gnu free documentation
license if you have invariant sections front cover texts and back cover texts replace the with texts line with this with the invariant sections being
list their titles with the front cover texts being list and with the back cover texts being list if you have invariant sections without cover texts or
some other combination of the three merge those two alternatives to suit the situation if your document contains nontrivial examples of program code
we recommend releasing these examples in parallel under your choice of free software license such as the gnu general public license to permit their
use in free software""",
    "GPL-1.0": """
gnu general public license version 1 february 1989 copyright c 1989 free software foundation inc 51 franklin st fifth floor boston ma 02110 1301 usa
everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed preamble the license agreements
of most software companies try to keep users at the mercy of those companies by contrast our general public license is intended to guarantee your
freedom to share and change free software to make sure the software is free for all its users the general public license applies to the free software
foundation s software and to any other program whose authors commit to using it you can use it for your programs too when we speak of free software we
are referring to freedom not price specifically the general public license is designed to make sure that you have the freedom to give away or sell
copies of free software that you receive source code or can get it if you want it that you can change the software or use pieces of it in new free
programs and that you know you can do these things to protect your rights we need to make restrictions that forbid anyone to deny you these rights or
to ask you to surrender the rights these restrictions translate to certain responsibilities for you if you distribute copies of the software or if you
modify it for example if you distribute copies of a such a program whether gratis or for a fee you must give the recipients all the rights that you
have you must make sure that they too receive or can get the source code and you must tell them their rights we protect your rights with two steps 1
copyright the software and 2 offer you this license which gives you legal permission to copy distribute and or modify the software also for each
author s protection and ours we want to make certain that everyone understands that there is no warranty for this free software if the software is
modified by someone else and passed on we want its recipients to know that what they have is not the original so that any problems introduced by
others will not reflect on the original authors reputations the precise terms and conditions for copying distribution and modification follow gnu
general public license terms and conditions for copying distribution and modification 0 this license agreement applies to any program or other work
which contains a notice placed by the copyright holder saying it may be distributed under the terms of this general public license the program below
refers to any such program or work and a work based on the program means either the program or any work containing the program or a portion of it
either verbatim or with modifications each licensee is addressed as you 1 you may copy and distribute verbatim copies of the program s source code as
you receive it in any medium provided that you conspicuously and appropriately publish on each copy an appropriate copyright notice and disclaimer of
warranty keep intact all the notices that refer to this general public license and to the absence of any warranty and give any other recipients of the
program a copy of this general public license along with the program you may charge a fee for the physical act of transferring a copy 2 you may modify
your copy or copies of the program or any portion of it and copy and distribute such modifications under the terms of paragraph 1 above provided that
you also do the following a cause the modified files to carry prominent notices stating that you changed the files and the date of any change and b
cause the whole of any work that you distribute or publish that in whole or in part contains the program or any part thereof either with or without
modifications to be licensed at no charge to all third parties under the terms of this general public license except that you may choose to grant
warranty protection to some or all third parties at your option c if the modified program normally reads commands interactively when run you must
cause it when started running for such interactive use in the simplest and most usual way to print or display an announcement including an appropriate
copyright notice and a notice that there is no warranty or else saying that you provide a warranty and that users may redistribute the program under
these conditions and telling the user how to view a copy of this general public license d you may charge a fee for the physical act of transferring a
copy and you may at your option offer warranty protection in exchange for a fee mere aggregation of another independent work with the program or its
derivative on a volume of a storage or distribution medium does not bring the other work under the scope of these terms 3 you may copy and distribute
the program or a portion or derivative of it under paragraph 2 in object code or executable form under the terms of paragraphs 1 and 2 above provided
that you also do one of the following a accompany it with the complete corresponding machine readable source code which must be distributed under the
terms of paragraphs 1 and 2 above or b accompany it with a written offer valid for at least three years to give any third party free except for a
nominal charge for the cost of distribution a complete machine readable copy of the corresponding source code to be distributed under the terms of
paragraphs 1 and 2 above or c accompany it with the information you received as to where the corresponding source code may be obtained this
alternative is allowed only for noncommercial distribution and only if you received the program in object code or executable form alone source code
for a work means the preferred form of the work for making modifications to it for an executable file complete source code means all the source code
for all modules it contains but as a special exception it need not include source code for modules which are standard libraries that accompany the
operating system on which the executable file runs or for standard header files or definitions files that accompany that operating system 4 you may
not copy modify sublicense distribute or transfer the program except as expressly provided under this general public license any attempt otherwise to
copy modify sublicense distribute or transfer the program is void and will automatically terminate your rights to use the program under this license
however parties who have received copies or rights to use copies from you under this general public license will not have their licenses terminated so
long as such parties remain in full compliance 5 by copying distributing or modifying the program or any work based on the program you indicate your
acceptance of this license to do so and all its terms and conditions 6 each time you redistribute the program or any work based on the program the
recipient automatically receives a license from the original licensor to copy distribute or modify the program subject to these terms and conditions
you may not impose any further restrictions on the recipients exercise of the rights granted herein 7 the free software foundation may publish revised
and or new versions of the general public license from time to time such new versions will be similar in spirit to the present version but may differ
in detail to address new problems or concerns each version is given a distinguishing version number if the program specifies a version number of the
license which applies to it and any later version you have the option of following the terms and conditions either of that version or of any later
version published by the free software foundation if the program does not specify a version number of the license you may choose any version ever
published by the free software foundation 8 if you wish to incorporate parts of the program into other free programs whose distribution conditions are
different write to the author to ask for permission for software which is copyrighted by the free software foundation write to the free software
foundation we sometimes make exceptions for this our decision will be guided by the two goals of preserving the free status of all derivatives of our
free software and of promoting the sharing and reuse of software generally no warranty 9 because the program is licensed free of charge there is no
warranty for the program to the extent permitted by applicable law except when otherwise stated in writing the copyright holders and or other parties
provide the program as is without warranty of any kind either expressed or implied including but not limited to the implied warranties of
merchantability and fitness for a particular purpose the entire risk as to the quality and performance of the program is with you should the program
prove defective you assume the cost of all necessary servicing repair or correction 10 in no event unless required by applicable law or agreed to in
writing will any copyright holder or any other party who may modify and or redistribute the program as permitted above be liable to you for damages
including any general special incidental or consequential damages arising out of the use or inability to use the program including but not limited to
loss of data or data being rendered inaccurate or losses sustained by you or third parties or a failure of the program to operate with any other
programs even if such holder or other party has been advised of the possibility of such damages end of terms and conditions appendix how to apply
these terms to your new programs if you develop a new program and you want it to be of the greatest possible use to humanity the best way to achieve
this is to make it free software which everyone can redistribute and change under these terms to do so attach the following notices to the program it
is safest to attach them to the start of each source file to most effectively convey the exclusion of warranty and each file should have at least the
copyright line and a pointer to where the full notice is found one line to give the program s name and a brief idea of what it does copyright c 19yy
name of author this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published
by the free software foundation either version 1 or at your option any later version this program is distributed in the hope that it will be useful
but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license
for more details you should have received a copy of the gnu general public license along with this program if not write to the free software
foundation inc 51 franklin street fifth floor boston ma 02110 1301 usa also add information on how to contact you by electronic and paper mail if the
program is interactive make it output a short notice like this when it starts in an interactive mode gnomovision version 69 copyright c 19xx name of
author gnomovision comes with absolutely no warranty for details type show w this is free software and you are welcome to redistribute it under
certain conditions type show c for details the hypothetical commands show w and show c should show the appropriate parts of the general public license
of course the commands you use may be called something other than show w and show c they could even be mouse clicks or menu items whatever suits your
program you should also get your employer if you work as a programmer or your school if any to sign a copyright disclaimer for the program if
necessary here a sample alter the names yoyodyne inc hereby disclaims all copyright interest in the program gnomovision a program to direct compilers
to make passes at assemblers written by james hacker signature of ty coon 1 april 1989 ty coon president of vice that s all there is to it""",
    "GPL-2.0": """
gnu general public license version 2 june 1991 copyright c 1989 1991 free software foundation inc 51 franklin street fifth floor boston ma 02110 1301
usa everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed preamble the licenses for
most software are designed to take away your freedom to share and change it by contrast the gnu general public license is intended to guarantee your
freedom to share and change free software to make sure the software is free for all its users this general public license applies to most of the free
software foundation s software and to any other program whose authors commit to using it some other free software foundation software is covered by
the gnu lesser general public license instead you can apply it to your programs too when we speak of free software we are referring to freedom not
price our general public licenses are designed to make sure that you have the freedom to distribute copies of free software and charge for this
service if you wish that you receive source code or can get it if you want it that you can change the software or use pieces of it in new free
programs and that you know you can do these things to protect your rights we need to make restrictions that forbid anyone to deny you these rights or
to ask you to surrender the rights these restrictions translate to certain responsibilities for you if you distribute copies of the software or if you
modify it for example if you distribute copies of such a program whether gratis or for a fee you must give the recipients all the rights that you have
you must make sure that they too receive or can get the source code and you must show them these terms so they know their rights we protect your
rights with two steps 1 copyright the software and 2 offer you this license which gives you legal permission to copy distribute and or modify the
software also for each author s protection and ours we want to make certain that everyone understands that there is no warranty for this free software
if the software is modified by someone else and passed on we want its recipients to know that what they have is not the original so that any problems
introduced by others will not reflect on the original authors reputations finally any free program is threatened constantly by software patents we
wish to avoid the danger that redistributors of a free program will individually obtain patent licenses in effect making the program proprietary to
prevent this we have made it clear that any patent must be licensed for everyone s free use or not licensed at all the precise terms and conditions
for copying distribution and modification follow gnu general public license terms and conditions for copying distribution and modification 0 this
license applies to any program or other work which contains a notice placed by the copyright holder saying it may be distributed under the terms of
this general public license the program below refers to any such program or work and a work based on the program means either the program or any
derivative work under copyright law that is to say a work containing the program or a portion of it either verbatim or with modifications and or
translated into another language hereinafter translation is included without limitation in the term modification each licensee is addressed as you
activities other than copying distribution and modification are not covered by this license they are outside its scope the act of running the program
is not restricted and the output from the program is covered only if its contents constitute a work based on the program independent of having been
made by running the program whether that is true depends on what the program does 1 you may copy and distribute verbatim copies of the program s
source code as you receive it in any medium provided that you conspicuously and appropriately publish on each copy an appropriate copyright notice and
disclaimer of warranty keep intact all the notices that refer to this license and to the absence of any warranty and give any other recipients of the
program a copy of this license along with the program you may charge a fee for the physical act of transferring a copy and you may at your option
offer warranty protection in exchange for a fee 2 you may modify your copy or copies of the program or any portion of it thus forming a work based on
the program and copy and distribute such modifications or work under the terms of section 1 above provided that you also meet all of these conditions
a you must cause the modified files to carry prominent notices stating that you changed the files and the date of any change b you must cause any work
that you distribute or publish that in whole or in part contains or is derived from the program or any part thereof to be licensed as a whole at no
charge to all third parties under the terms of this license c if the modified program normally reads commands interactively when run you must cause it
when started running for such interactive use in the most ordinary way to print or display an announcement including an appropriate copyright notice
and a notice that there is no warranty or else saying that you provide a warranty and that users may redistribute the program under these conditions
and telling the user how to view a copy of this license exception if the program itself is interactive but does not normally print such an
announcement your work based on the program is not required to print an announcement these requirements apply to the modified work as a whole if
identifiable sections of that work are not derived from the program and can be reasonably considered independent and separate works in themselves then
this license and its terms do not apply to those sections when you distribute them as separate works but when you distribute the same sections as part
of a whole which is a work based on the program the distribution of the whole must be on the terms of this license whose permissions for other
licensees extend to the entire whole and thus to each and every part regardless of who wrote it thus it is not the intent of this section to claim
rights or contest your rights to work written entirely by you rather the intent is to exercise the right to control the distribution of derivative or
collective works based on the program in addition mere aggregation of another work not based on the program with the program or with a work based on
the program on a volume of a storage or distribution medium does not bring the other work under the scope of this license 3 you may copy and
distribute the program or a work based on it under section 2 in object code or executable form under the terms of sections 1 and 2 above provided that
you also do one of the following a accompany it with the complete corresponding machine readable source code which must be distributed under the terms
of sections 1 and 2 above on a medium customarily used for software interchange or b accompany it with a written offer valid for at least three years
to give any third party for a charge no more than your cost of physically performing source distribution a complete machine readable copy of the
corresponding source code to be distributed under the terms of sections 1 and 2 above on a medium customarily used for software interchange or c
accompany it with the information you received as to the offer to distribute corresponding source code this alternative is allowed only for
noncommercial distribution and only if you received the program in object code or executable form with such an offer in accord with subsection b above
the source code for a work means the preferred form of the work for making modifications to it for an executable work complete source code means all
the source code for all modules it contains plus any associated interface definition files plus the scripts used to control compilation and
installation of the executable however as a special exception the source code distributed need not include anything that is normally distributed in
either source or binary form with the major components compiler kernel and so on of the operating system on which the executable runs unless that
component itself accompanies the executable if distribution of executable or object code is made by offering access to copy from a designated place
then offering equivalent access to copy the source code from the same place counts as distribution of the source code even though third parties are
not compelled to copy the source along with the object code 4 you may not copy modify sublicense or distribute the program except as expressly
provided under this license any attempt otherwise to copy modify sublicense or distribute the program is void and will automatically terminate your
rights under this license however parties who have received copies or rights from you under this license will not have their licenses terminated so
long as such parties remain in full compliance 5 you are not required to accept this license since you have not signed it however nothing else grants
you permission to modify or distribute the program or its derivative works these actions are prohibited by law if you do not accept this license
therefore by modifying or distributing the program or any work based on the program you indicate your acceptance of this license to do so and all its
terms and conditions for copying distributing or modifying the program or works based on it 6 each time you redistribute the program or any work based
on the program the recipient automatically receives a license from the original licensor to copy distribute or modify the program subject to these
terms and conditions you may not impose any further restrictions on the recipients exercise of the rights granted herein you are not responsible for
enforcing compliance by third parties to this license 7 if as a consequence of a court judgment or allegation of patent infringement or for any other
reason not limited to patent issues conditions are imposed on you whether by court order agreement or otherwise that contradict the conditions of this
license they do not excuse you from the conditions of this license if you cannot distribute so as to satisfy simultaneously your obligations under
this license and any other pertinent obligations then as a consequence you may not distribute the program at all for example if a patent license would
not permit royalty free redistribution of the program by all those who receive copies directly or indirectly through you then the only way you could
satisfy both it and this license would be to refrain entirely from distribution of the program if any portion of this section is held invalid or
unenforceable under any particular circumstance the balance of the section is intended to apply and the section as a whole is intended to apply in
other circumstances it is not the purpose of this section to induce you to infringe any patents or other property right claims or to contest validity
of any such claims this section has the sole purpose of protecting the integrity of the free software distribution system which is implemented by
public license practices many people have made generous contributions to the wide range of software distributed through that system in reliance on
consistent application of that system it is up to the author donor to decide if he or she is willing to distribute software through any other system
and a licensee cannot impose that choice this section is intended to make thoroughly clear what is believed to be a consequence of the rest of this
license 8 if the distribution and or use of the program is restricted in certain countries either by patents or by copyrighted interfaces the original
copyright holder who places the program under this license may add an explicit geographical distribution limitation excluding those countries so that
distribution is permitted only in or among countries not thus excluded in such case this license incorporates the limitation as if written in the body
of this license 9 the free software foundation may publish revised and or new versions of the general public license from time to time such new
versions will be similar in spirit to the present version but may differ in detail to address new problems or concerns each version is given a
distinguishing version number if the program specifies a version number of this license which applies to it and any later version you have the option
of following the terms and conditions either of that version or of any later version published by the free software foundation if the program does not
specify a version number of this license you may choose any version ever published by the free software foundation 10 if you wish to incorporate parts
of the program into other free programs whose distribution conditions are different write to the author to ask for permission for software which is
copyrighted by the free software foundation write to the free software foundation we sometimes make exceptions for this our decision will be guided by
the two goals of preserving the free status of all derivatives of our free software and of promoting the sharing and reuse of software generally no
warranty 11 because the program is licensed free of charge there is no warranty for the program to the extent permitted by applicable law except when
otherwise stated in writing the copyright holders and or other parties provide the program as is without warranty of any kind either expressed or
implied including but not limited to the implied warranties of merchantability and fitness for a particular purpose the entire risk as to the quality
and performance of the program is with you should the program prove defective you assume the cost of all necessary servicing repair or correction 12
in no event unless required by applicable law or agreed to in writing will any copyright holder or any other party who may modify and or redistribute
the program as permitted above be liable to you for damages including any general special incidental or consequential damages arising out of the use
or inability to use the program including but not limited to loss of data or data being rendered inaccurate or losses sustained by you or third
parties or a failure of the program to operate with any other programs even if such holder or other party has been advised of the possibility of such
damages end of terms and conditions how to apply these terms to your new programs if you develop a new program and you want it to be of the greatest
possible use to the public the best way to achieve this is to make it free software which everyone can redistribute and change under these terms to do
so attach the following notices to the program it is safest to attach them to the start of each source file to most effectively convey the exclusion
of warranty and each file should have at least the copyright line and a pointer to where the full notice is found one line to give the program s name
and a brief idea of what it does copyright c year name of author this program is free software you can redistribute it and or modify it under the
terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later
version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability
or fitness for a particular purpose see the gnu general public license for more details you should have received a copy of the gnu general public
license along with this program if not write to the free software foundation inc 51 franklin street fifth floor boston ma 02110 1301 usa also add
information on how to contact you by electronic and paper mail if the program is interactive make it output a short notice like this when it starts in
an interactive mode gnomovision version 69 copyright c year name of author gnomovision comes with absolutely no warranty for details type show w this
is free software and you are welcome to redistribute it under certain conditions type show c for details the hypothetical commands show w and show c
should show the appropriate parts of the general public license of course the commands you use may be called something other than show w and show c
they could even be mouse clicks or menu items whatever suits your program you should also get your employer if you work as a programmer or your school
if any to sign a copyright disclaimer for the program if necessary here is a sample alter the names yoyodyne inc hereby disclaims all copyright
interest in the program gnomovision which makes passes at compilers written by james hacker signature of ty coon 1 april 1989 ty coon president of
vice this general public license does not permit incorporating your program into proprietary programs if your program is a subroutine library you may
consider it more useful to permit linking proprietary applications with the library if this is what you want to do use the gnu lesser general public
license instead of this license""",
    "GPL-3.0": """
gnu general public license version 3 29 june 2007 copyright c 2007 free software foundation inc https fsf org everyone is permitted to copy and
distribute verbatim copies of this license document but changing it is not allowed preamble the gnu general public license is a free copyleft license
for software and other kinds of works the licenses for most software and other practical works are designed to take away your freedom to share and
change the works by contrast the gnu general public license is intended to guarantee your freedom to share and change all versions of a program to
make sure it remains free software for all its users we the free software foundation use the gnu general public license for most of our software it
applies also to any other work released this way by its authors you can apply it to your programs too when we speak of free software we are referring
to freedom not price our general public licenses are designed to make sure that you have the freedom to distribute copies of free software and charge
for them if you wish that you receive source code or can get it if you want it that you can change the software or use pieces of it in new free
programs and that you know you can do these things to protect your rights we need to prevent others from denying you these rights or asking you to
surrender the rights therefore you have certain responsibilities if you distribute copies of the software or if you modify it responsibilities to
respect the freedom of others for example if you distribute copies of such a program whether gratis or for a fee you must pass on to the recipients
the same freedoms that you received you must make sure that they too receive or can get the source code and you must show them these terms so they
know their rights developers that use the gnu gpl protect your rights with two steps 1 assert copyright on the software and 2 offer you this license
giving you legal permission to copy distribute and or modify it for the developers and authors protection the gpl clearly explains that there is no
warranty for this free software for both users and authors sake the gpl requires that modified versions be marked as changed so that their problems
will not be attributed erroneously to authors of previous versions some devices are designed to deny users access to install or run modified versions
of the software inside them although the manufacturer can do so this is fundamentally incompatible with the aim of protecting users freedom to change
the software the systematic pattern of such abuse occurs in the area of products for individuals to use which is precisely where it is most
unacceptable therefore we have designed this version of the gpl to prohibit the practice for those products if such problems arise substantially in
other domains we stand ready to extend this provision to those domains in future versions of the gpl as needed to protect the freedom of users finally
every program is threatened constantly by software patents states should not allow patents to restrict development and use of software on general
purpose computers but in those that do we wish to avoid the special danger that patents applied to a free program could make it effectively
proprietary to prevent this the gpl assures that patents cannot be used to render the program non free the precise terms and conditions for copying
distribution and modification follow terms and conditions 0 definitions this license refers to version 3 of the gnu general public license copyright
also means copyright like laws that apply to other kinds of works such as semiconductor masks the program refers to any copyrightable work licensed
under this license each licensee is addressed as you licensees and recipients may be individuals or organizations to modify a work means to copy from
or adapt all or part of the work in a fashion requiring copyright permission other than the making of an exact copy the resulting work is called a
modified version of the earlier work or a work based on the earlier work a covered work means either the unmodified program or a work based on the
program to propagate a work means to do anything with it that without permission would make you directly or secondarily liable for infringement under
applicable copyright law except executing it on a computer or modifying a private copy propagation includes copying distribution with or without
modification making available to the public and in some countries other activities as well to convey a work means any kind of propagation that enables
other parties to make or receive copies mere interaction with a user through a computer network with no transfer of a copy is not conveying an
interactive user interface displays appropriate legal notices to the extent that it includes a convenient and prominently visible feature that 1
displays an appropriate copyright notice and 2 tells the user that there is no warranty for the work except to the extent that warranties are provided
that licensees may convey the work under this license and how to view a copy of this license if the interface presents a list of user commands or
options such as a menu a prominent item in the list meets this criterion 1 source code the source code for a work means the preferred form of the work
for making modifications to it object code means any non source form of a work a standard interface means an interface that either is an official
standard defined by a recognized standards body or in the case of interfaces specified for a particular programming language one that is widely used
among developers working in that language the system libraries of an executable work include anything other than the work as a whole that a is
included in the normal form of packaging a major component but which is not part of that major component and b serves only to enable use of the work
with that major component or to implement a standard interface for which an implementation is available to the public in source code form a major
component in this context means a major essential component kernel window system and so on of the specific operating system if any on which the
executable work runs or a compiler used to produce the work or an object code interpreter used to run it the corresponding source for a work in object
code form means all the source code needed to generate install and for an executable work run the object code and to modify the work including scripts
to control those activities however it does not include the work s system libraries or general purpose tools or generally available free programs
which are used unmodified in performing those activities but which are not part of the work for example corresponding source includes interface
definition files associated with source files for the work and the source code for shared libraries and dynamically linked subprograms that the work
is specifically designed to require such as by intimate data communication or control flow between those subprograms and other parts of the work the
corresponding source need not include anything that users can regenerate automatically from other parts of the corresponding source the corresponding
source for a work in source code form is that same work 2 basic permissions all rights granted under this license are granted for the term of
copyright on the program and are irrevocable provided the stated conditions are met this license explicitly affirms your unlimited permission to run
the unmodified program the output from running a covered work is covered by this license only if the output given its content constitutes a covered
work this license acknowledges your rights of fair use or other equivalent as provided by copyright law you may make run and propagate covered works
that you do not convey without conditions so long as your license otherwise remains in force you may convey covered works to others for the sole
purpose of having them make modifications exclusively for you or provide you with facilities for running those works provided that you comply with the
terms of this license in conveying all material for which you do not control copyright those thus making or running the covered works for you must do
so exclusively on your behalf under your direction and control on terms that prohibit them from making any copies of your copyrighted material outside
their relationship with you conveying under any other circumstances is permitted solely under the conditions stated below sublicensing is not allowed
section 10 makes it unnecessary 3 protecting users legal rights from anti circumvention law no covered work shall be deemed part of an effective
technological measure under any applicable law fulfilling obligations under article 11 of the wipo copyright treaty adopted on 20 december 1996 or
similar laws prohibiting or restricting circumvention of such measures when you convey a covered work you waive any legal power to forbid
circumvention of technological measures to the extent such circumvention is effected by exercising rights under this license with respect to the
covered work and you disclaim any intention to limit operation or modification of the work as a means of enforcing against the work s users your or
third parties legal rights to forbid circumvention of technological measures 4 conveying verbatim copies you may convey verbatim copies of the program
s source code as you receive it in any medium provided that you conspicuously and appropriately publish on each copy an appropriate copyright notice
keep intact all notices stating that this license and any non permissive terms added in accord with section 7 apply to the code keep intact all
notices of the absence of any warranty and give all recipients a copy of this license along with the program you may charge any price or no price for
each copy that you convey and you may offer support or warranty protection for a fee 5 conveying modified source versions you may convey a work based
on the program or the modifications to produce it from the program in the form of source code under the terms of section 4 provided that you also meet
all of these conditions a the work must carry prominent notices stating that you modified it and giving a relevant date b the work must carry
prominent notices stating that it is released under this license and any conditions added under section 7 this requirement modifies the requirement in
section 4 to keep intact all notices c you must license the entire work as a whole under this license to anyone who comes into possession of a copy
this license will therefore apply along with any applicable section 7 additional terms to the whole of the work and all its parts regardless of how
they are packaged this license gives no permission to license the work in any other way but it does not invalidate such permission if you have
separately received it d if the work has interactive user interfaces each must display appropriate legal notices however if the program has
interactive interfaces that do not display appropriate legal notices your work need not make them do so a compilation of a covered work with other
separate and independent works which are not by their nature extensions of the covered work and which are not combined with it such as to form a
larger program in or on a volume of a storage or distribution medium is called an aggregate if the compilation and its resulting copyright are not
used to limit the access or legal rights of the compilation s users beyond what the individual works permit inclusion of a covered work in an
aggregate does not cause this license to apply to the other parts of the aggregate 6 conveying non source forms you may convey a covered work in
object code form under the terms of sections 4 and 5 provided that you also convey the machine readable corresponding source under the terms of this
license in one of these ways a convey the object code in or embodied in a physical product including a physical distribution medium accompanied by the
corresponding source fixed on a durable physical medium customarily used for software interchange b convey the object code in or embodied in a
physical product including a physical distribution medium accompanied by a written offer valid for at least three years and valid for as long as you
offer spare parts or customer support for that product model to give anyone who possesses the object code either 1 a copy of the corresponding source
for all the software in the product that is covered by this license on a durable physical medium customarily used for software interchange for a price
no more than your reasonable cost of physically performing this conveying of source or 2 access to copy the corresponding source from a network server
at no charge c convey individual copies of the object code with a copy of the written offer to provide the corresponding source this alternative is
allowed only occasionally and noncommercially and only if you received the object code with such an offer in accord with subsection 6b d convey the
object code by offering access from a designated place gratis or for a charge and offer equivalent access to the corresponding source in the same way
through the same place at no further charge you need not require recipients to copy the corresponding source along with the object code if the place
to copy the object code is a network server the corresponding source may be on a different server operated by you or a third party that supports
equivalent copying facilities provided you maintain clear directions next to the object code saying where to find the corresponding source regardless
of what server hosts the corresponding source you remain obligated to ensure that it is available for as long as needed to satisfy these requirements
e convey the object code using peer to peer transmission provided you inform other peers where the object code and corresponding source of the work
are being offered to the general public at no charge under subsection 6d a separable portion of the object code whose source code is excluded from the
corresponding source as a system library need not be included in conveying the object code work a user product is either 1 a consumer product which
means any tangible personal property which is normally used for personal family or household purposes or 2 anything designed or sold for incorporation
into a dwelling in determining whether a product is a consumer product doubtful cases shall be resolved in favor of coverage for a particular product
received by a particular user normally used refers to a typical or common use of that class of product regardless of the status of the particular user
or of the way in which the particular user actually uses or expects or is expected to use the product a product is a consumer product regardless of
whether the product has substantial commercial industrial or non consumer uses unless such uses represent the only significant mode of use of the
product installation information for a user product means any methods procedures authorization keys or other information required to install and
execute modified versions of a covered work in that user product from a modified version of its corresponding source the information must suffice to
ensure that the continued functioning of the modified object code is in no case prevented or interfered with solely because modification has been made
if you convey an object code work under this section in or with or specifically for use in a user product and the conveying occurs as part of a
transaction in which the right of possession and use of the user product is transferred to the recipient in perpetuity or for a fixed term regardless
of how the transaction is characterized the corresponding source conveyed under this section must be accompanied by the installation information but
this requirement does not apply if neither you nor any third party retains the ability to install modified object code on the user product for example
the work has been installed in rom the requirement to provide installation information does not include a requirement to continue to provide support
service warranty or updates for a work that has been modified or installed by the recipient or for the user product in which it has been modified or
installed access to a network may be denied when the modification itself materially and adversely affects the operation of the network or violates the
rules and protocols for communication across the network corresponding source conveyed and installation information provided in accord with this
section must be in a format that is publicly documented and with an implementation available to the public in source code form and must require no
special password or key for unpacking reading or copying 7 additional terms additional permissions are terms that supplement the terms of this license
by making exceptions from one or more of its conditions additional permissions that are applicable to the entire program shall be treated as though
they were included in this license to the extent that they are valid under applicable law if additional permissions apply only to part of the program
that part may be used separately under those permissions but the entire program remains governed by this license without regard to the additional
permissions when you convey a copy of a covered work you may at your option remove any additional permissions from that copy or from any part of it
additional permissions may be written to require their own removal in certain cases when you modify the work you may place additional permissions on
material added by you to a covered work for which you have or can give appropriate copyright permission notwithstanding any other provision of this
license for material you add to a covered work you may if authorized by the copyright holders of that material supplement the terms of this license
with terms a disclaiming warranty or limiting liability differently from the terms of sections 15 and 16 of this license or b requiring preservation
of specified reasonable legal notices or author attributions in that material or in the appropriate legal notices displayed by works containing it or
c prohibiting misrepresentation of the origin of that material or requiring that modified versions of such material be marked in reasonable ways as
different from the original version or d limiting the use for publicity purposes of names of licensors or authors of the material or e declining to
grant rights under trademark law for use of some trade names trademarks or service marks or f requiring indemnification of licensors and authors of
that material by anyone who conveys the material or modified versions of it with contractual assumptions of liability to the recipient for any
liability that these contractual assumptions directly impose on those licensors and authors all other non permissive additional terms are considered
further restrictions within the meaning of section 10 if the program as you received it or any part of it contains a notice stating that it is
governed by this license along with a term that is a further restriction you may remove that term if a license document contains a further restriction
but permits relicensing or conveying under this license you may add to a covered work material governed by the terms of that license document provided
that the further restriction does not survive such relicensing or conveying if you add terms to a covered work in accord with this section you must
place in the relevant source files a statement of the additional terms that apply to those files or a notice indicating where to find the applicable
terms additional terms permissive or non permissive may be stated in the form of a separately written license or stated as exceptions the above
requirements apply either way 8 termination you may not propagate or modify a covered work except as expressly provided under this license any attempt
otherwise to propagate or modify it is void and will automatically terminate your rights under this license including any patent licenses granted
under the third paragraph of section 11 however if you cease all violation of this license then your license from a particular copyright holder is
reinstated a provisionally unless and until the copyright holder explicitly and finally terminates your license and b permanently if the copyright
holder fails to notify you of the violation by some reasonable means prior to 60 days after the cessation moreover your license from a particular
copyright holder is reinstated permanently if the copyright holder notifies you of the violation by some reasonable means this is the first time you
have received notice of violation of this license for any work from that copyright holder and you cure the violation prior to 30 days after your
receipt of the notice termination of your rights under this section does not terminate the licenses of parties who have received copies or rights from
you under this license if your rights have been terminated and not permanently reinstated you do not qualify to receive new licenses for the same
material under section 10 9 acceptance not required for having copies you are not required to accept this license in order to receive or run a copy of
the program ancillary propagation of a covered work occurring solely as a consequence of using peer to peer transmission to receive a copy likewise
does not require acceptance however nothing other than this license grants you permission to propagate or modify any covered work these actions
infringe copyright if you do not accept this license therefore by modifying or propagating a covered work you indicate your acceptance of this license
to do so 10 automatic licensing of downstream recipients each time you convey a covered work the recipient automatically receives a license from the
original licensors to run modify and propagate that work subject to this license you are not responsible for enforcing compliance by third parties
with this license an entity transaction is a transaction transferring control of an organization or substantially all assets of one or subdividing an
organization or merging organizations if propagation of a covered work results from an entity transaction each party to that transaction who receives
a copy of the work also receives whatever licenses to the work the party s predecessor in interest had or could give under the previous paragraph plus
a right to possession of the corresponding source of the work from the predecessor in interest if the predecessor has it or can get it with reasonable
efforts you may not impose any further restrictions on the exercise of the rights granted or affirmed under this license for example you may not
impose a license fee royalty or other charge for exercise of rights granted under this license and you may not initiate litigation including a cross
claim or counterclaim in a lawsuit alleging that any patent claim is infringed by making using selling offering for sale or importing the program or
any portion of it 11 patents a contributor is a copyright holder who authorizes use under this license of the program or a work on which the program
is based the work thus licensed is called the contributor s contributor version a contributor s essential patent claims are all patent claims owned or
controlled by the contributor whether already acquired or hereafter acquired that would be infringed by some manner permitted by this license of
making using or selling its contributor version but do not include claims that would be infringed only as a consequence of further modification of the
contributor version for purposes of this definition control includes the right to grant patent sublicenses in a manner consistent with the
requirements of this license each contributor grants you a non exclusive worldwide royalty free patent license under the contributor s essential
patent claims to make use sell offer for sale import and otherwise run modify and propagate the contents of its contributor version in the following
three paragraphs a patent license is any express agreement or commitment however denominated not to enforce a patent such as an express permission to
practice a patent or covenant not to sue for patent infringement to grant such a patent license to a party means to make such an agreement or
commitment not to enforce a patent against the party if you convey a covered work knowingly relying on a patent license and the corresponding source
of the work is not available for anyone to copy free of charge and under the terms of this license through a publicly available network server or
other readily accessible means then you must either 1 cause the corresponding source to be so available or 2 arrange to deprive yourself of the
benefit of the patent license for this particular work or 3 arrange in a manner consistent with the requirements of this license to extend the patent
license to downstream recipients knowingly relying means you have actual knowledge that but for the patent license your conveying the covered work in
a country or your recipient s use of the covered work in a country would infringe one or more identifiable patents in that country that you have
reason to believe are valid if pursuant to or in connection with a single transaction or arrangement you convey or propagate by procuring conveyance
of a covered work and grant a patent license to some of the parties receiving the covered work authorizing them to use propagate modify or convey a
specific copy of the covered work then the patent license you grant is automatically extended to all recipients of the covered work and works based on
it a patent license is discriminatory if it does not include within the scope of its coverage prohibits the exercise of or is conditioned on the non
exercise of one or more of the rights that are specifically granted under this license you may not convey a covered work if you are a party to an
arrangement with a third party that is in the business of distributing software under which you make payment to the third party based on the extent of
your activity of conveying the work and under which the third party grants to any of the parties who would receive the covered work from you a
discriminatory patent license a in connection with copies of the covered work conveyed by you or copies made from those copies or b primarily for and
in connection with specific products or compilations that contain the covered work unless you entered into that arrangement or that patent license was
granted prior to 28 march 2007 nothing in this license shall be construed as excluding or limiting any implied license or other defenses to
infringement that may otherwise be available to you under applicable patent law 12 no surrender of others freedom if conditions are imposed on you
whether by court order agreement or otherwise that contradict the conditions of this license they do not excuse you from the conditions of this
license if you cannot convey a covered work so as to satisfy simultaneously your obligations under this license and any other pertinent obligations
then as a consequence you may not convey it at all for example if you agree to terms that obligate you to collect a royalty for further conveying from
those to whom you convey the program the only way you could satisfy both those terms and this license would be to refrain entirely from conveying the
program 13 use with the gnu affero general public license notwithstanding any other provision of this license you have permission to link or combine
any covered work with a work licensed under version 3 of the gnu affero general public license into a single combined work and to convey the resulting
work the terms of this license will continue to apply to the part which is the covered work but the special requirements of the gnu affero general
public license section 13 concerning interaction through a network will apply to the combination as such 14 revised versions of this license the free
software foundation may publish revised and or new versions of the gnu general public license from time to time such new versions will be similar in
spirit to the present version but may differ in detail to address new problems or concerns each version is given a distinguishing version number if
the program specifies that a certain numbered version of the gnu general public license or any later version applies to it you have the option of
following the terms and conditions either of that numbered version or of any later version published by the free software foundation if the program
does not specify a version number of the gnu general public license you may choose any version ever published by the free software foundation if the
program specifies that a proxy can decide which future versions of the gnu general public license can be used that proxy s public statement of
acceptance of a version permanently authorizes you to choose that version for the program later license versions may give you additional or different
permissions however no additional obligations are imposed on any author or copyright holder as a result of your choosing to follow a later version 15
disclaimer of warranty there is no warranty for the program to the extent permitted by applicable law except when otherwise stated in writing the
copyright holders and or other parties provide the program as is without warranty of any kind either expressed or implied including but not limited to
the implied warranties of merchantability and fitness for a particular purpose the entire risk as to the quality and performance of the program is
with you should the program prove defective you assume the cost of all necessary servicing repair or correction 16 limitation of liability in no event
unless required by applicable law or agreed to in writing will any copyright holder or any other party who modifies and or conveys the program as
permitted above be liable to you for damages including any general special incidental or consequential damages arising out of the use or inability to
use the program including but not limited to loss of data or data being rendered inaccurate or losses sustained by you or third parties or a failure
of the program to operate with any other programs even if such holder or other party has been advised of the possibility of such damages 17
interpretation of sections 15 and 16 if the disclaimer of warranty and limitation of liability provided above cannot be given local legal effect
according to their terms reviewing courts shall apply local law that most closely approximates an absolute waiver of all civil liability in connection
with the program unless a warranty or assumption of liability accompanies a copy of the program in return for a fee end of terms and conditions how to
apply these terms to your new programs if you develop a new program and you want it to be of the greatest possible use to the public the best way to
achieve this is to make it free software which everyone can redistribute and change under these terms to do so attach the following notices to the
program it is safest to attach them to the start of each source file to most effectively state the exclusion of warranty and each file should have at
least the copyright line and a pointer to where the full notice is found one line to give the program s name and a brief idea of what it does
copyright c year name of author this program is free software you can redistribute it and or modify it under the terms of the gnu general public
license as published by the free software foundation either version 3 of the license or at your option any later version this program is distributed
in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose
see the gnu general public license for more details you should have received a copy of the gnu general public license along with this program if not
see https www gnu org licenses also add information on how to contact you by electronic and paper mail if the program does terminal interaction make
it output a short notice like this when it starts in an interactive mode program copyright c year name of author this program comes with absolutely no
warranty for details type show w this is free software and you are welcome to redistribute it under certain conditions type show c for details the
hypothetical commands show w and show c should show the appropriate parts of the general public license of course your program s commands might be
different for a gui interface you would use an about box you should also get your employer if you work as a programmer or school if any to sign a
copyright disclaimer for the program if necessary for more information on this and how to apply and follow the gnu gpl see https www gnu org licenses
the gnu general public license does not permit incorporating your program into proprietary programs if your program is a subroutine library you may
consider it more useful to permit linking proprietary applications with the library if this is what you want to do use the gnu lesser general public
license instead of this license but first please read https www gnu org licenses why not lgpl html""",
    "LGPL-2.0": """
gnu library general public license version 2 june 1991 copyright c 1991 free software foundation inc 51 franklin street fifth floor boston ma 02110
1301 usa everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed this is the first
released version of the library gpl it is numbered 2 because it goes with version 2 of the ordinary gpl preamble the licenses for most software are
designed to take away your freedom to share and change it by contrast the gnu general public licenses are intended to guarantee your freedom to share
and change free software to make sure the software is free for all its users this license the library general public license applies to some specially
designated free software foundation software and to any other libraries whose authors decide to use it you can use it for your libraries too when we
speak of free software we are referring to freedom not price our general public licenses are designed to make sure that you have the freedom to
distribute copies of free software and charge for this service if you wish that you receive source code or can get it if you want it that you can
change the software or use pieces of it in new free programs and that you know you can do these things to protect your rights we need to make
restrictions that forbid anyone to deny you these rights or to ask you to surrender the rights these restrictions translate to certain
responsibilities for you if you distribute copies of the library or if you modify it for example if you distribute copies of the library whether
gratis or for a fee you must give the recipients all the rights that we gave you you must make sure that they too receive or can get the source code
if you link a program with the library you must provide complete object files to the recipients so that they can relink them with the library after
making changes to the library and recompiling it and you must show them these terms so they know their rights our method of protecting your rights has
two steps 1 copyright the library and 2 offer you this license which gives you legal permission to copy distribute and or modify the library also for
each distributor s protection we want to make certain that everyone understands that there is no warranty for this free library if the library is
modified by someone else and passed on we want its recipients to know that what they have is not the original version so that any problems introduced
by others will not reflect on the original authors reputations finally any free program is threatened constantly by software patents we wish to avoid
the danger that companies distributing free software will individually obtain patent licenses thus in effect transforming the program into proprietary
software to prevent this we have made it clear that any patent must be licensed for everyone s free use or not licensed at all most gnu software
including some libraries is covered by the ordinary gnu general public license which was designed for utility programs this license the gnu library
general public license applies to certain designated libraries this license is quite different from the ordinary one be sure to read it in full and
don t assume that anything in it is the same as in the ordinary license the reason we have a separate public license for some libraries is that they
blur the distinction we usually make between modifying or adding to a program and simply using it linking a program with a library without changing
the library is in some sense simply using the library and is analogous to running a utility program or application program however in a textual and
legal sense the linked executable is a combined work a derivative of the original library and the ordinary general public license treats it as such
because of this blurred distinction using the ordinary general public license for libraries did not effectively promote software sharing because most
developers did not use the libraries we concluded that weaker conditions might promote sharing better however unrestricted linking of non free
programs would deprive the users of those programs of all benefit from the free status of the libraries themselves this library general public license
is intended to permit developers of non free programs to use free libraries while preserving your freedom as a user of such programs to change the
free libraries that are incorporated in them we have not seen how to achieve this as regards changes in header files but we have achieved it as
regards changes in the actual functions of the library the hope is that this will lead to faster development of free libraries the precise terms and
conditions for copying distribution and modification follow pay close attention to the difference between a work based on the library and a work that
uses the library the former contains code derived from the library while the latter only works together with the library note that it is possible for
a library to be covered by the ordinary general public license rather than by this special one gnu library general public license terms and conditions
for copying distribution and modification 0 this license agreement applies to any software library which contains a notice placed by the copyright
holder or other authorized party saying it may be distributed under the terms of this library general public license also called this license each
licensee is addressed as you a library means a collection of software functions and or data prepared so as to be conveniently linked with application
programs which use some of those functions and data to form executables the library below refers to any such software library or work which has been
distributed under these terms a work based on the library means either the library or any derivative work under copyright law that is to say a work
containing the library or a portion of it either verbatim or with modifications and or translated straightforwardly into another language hereinafter
translation is included without limitation in the term modification source code for a work means the preferred form of the work for making
modifications to it for a library complete source code means all the source code for all modules it contains plus any associated interface definition
files plus the scripts used to control compilation and installation of the library activities other than copying distribution and modification are not
covered by this license they are outside its scope the act of running a program using the library is not restricted and output from such a program is
covered only if its contents constitute a work based on the library independent of the use of the library in a tool for writing it whether that is
true depends on what the library does and what the program that uses the library does 1 you may copy and distribute verbatim copies of the library s
complete source code as you receive it in any medium provided that you conspicuously and appropriately publish on each copy an appropriate copyright
notice and disclaimer of warranty keep intact all the notices that refer to this license and to the absence of any warranty and distribute a copy of
this license along with the library you may charge a fee for the physical act of transferring a copy and you may at your option offer warranty
protection in exchange for a fee 2 you may modify your copy or copies of the library or any portion of it thus forming a work based on the library and
copy and distribute such modifications or work under the terms of section 1 above provided that you also meet all of these conditions a the modified
work must itself be a software library b you must cause the files modified to carry prominent notices stating that you changed the files and the date
of any change c you must cause the whole of the work to be licensed at no charge to all third parties under the terms of this license d if a facility
in the modified library refers to a function or a table of data to be supplied by an application program that uses the facility other than as an
argument passed when the facility is invoked then you must make a good faith effort to ensure that in the event an application does not supply such
function or table the facility still operates and performs whatever part of its purpose remains meaningful for example a function in a library to
compute square roots has a purpose that is entirely well defined independent of the application therefore subsection 2d requires that any application
supplied function or table used by this function must be optional if the application does not supply it the square root function must still compute
square roots these requirements apply to the modified work as a whole if identifiable sections of that work are not derived from the library and can
be reasonably considered independent and separate works in themselves then this license and its terms do not apply to those sections when you
distribute them as separate works but when you distribute the same sections as part of a whole which is a work based on the library the distribution
of the whole must be on the terms of this license whose permissions for other licensees extend to the entire whole and thus to each and every part
regardless of who wrote it thus it is not the intent of this section to claim rights or contest your rights to work written entirely by you rather the
intent is to exercise the right to control the distribution of derivative or collective works based on the library in addition mere aggregation of
another work not based on the library with the library or with a work based on the library on a volume of a storage or distribution medium does not
bring the other work under the scope of this license 3 you may opt to apply the terms of the ordinary gnu general public license instead of this
license to a given copy of the library to do this you must alter all the notices that refer to this license so that they refer to the ordinary gnu
general public license version 2 instead of to this license if a newer version than version 2 of the ordinary gnu general public license has appeared
then you can specify that version instead if you wish do not make any other change in these notices once this change is made in a given copy it is
irreversible for that copy so the ordinary gnu general public license applies to all subsequent copies and derivative works made from that copy this
option is useful when you wish to copy part of the code of the library into a program that is not a library 4 you may copy and distribute the library
or a portion or derivative of it under section 2 in object code or executable form under the terms of sections 1 and 2 above provided that you
accompany it with the complete corresponding machine readable source code which must be distributed under the terms of sections 1 and 2 above on a
medium customarily used for software interchange if distribution of object code is made by offering access to copy from a designated place then
offering equivalent access to copy the source code from the same place satisfies the requirement to distribute the source code even though third
parties are not compelled to copy the source along with the object code 5 a program that contains no derivative of any portion of the library but is
designed to work with the library by being compiled or linked with it is called a work that uses the library such a work in isolation is not a
derivative work of the library and therefore falls outside the scope of this license however linking a work that uses the library with the library
creates an executable that is a derivative of the library because it contains portions of the library rather than a work that uses the library the
executable is therefore covered by this license section 6 states terms for distribution of such executables when a work that uses the library uses
material from a header file that is part of the library the object code for the work may be a derivative work of the library even though the source
code is not whether this is true is especially significant if the work can be linked without the library or if the work is itself a library the
threshold for this to be true is not precisely defined by law if such an object file uses only numerical parameters data structure layouts and
accessors and small macros and small inline functions ten lines or less in length then the use of the object file is unrestricted regardless of
whether it is legally a derivative work executables containing this object code plus portions of the library will still fall under section 6 otherwise
if the work is a derivative of the library you may distribute the object code for the work under the terms of section 6 any executables containing
that work also fall under section 6 whether or not they are linked directly with the library itself 6 as an exception to the sections above you may
also compile or link a work that uses the library with the library to produce a work containing portions of the library and distribute that work under
terms of your choice provided that the terms permit modification of the work for the customer s own use and reverse engineering for debugging such
modifications you must give prominent notice with each copy of the work that the library is used in it and that the library and its use are covered by
this license you must supply a copy of this license if the work during execution displays copyright notices you must include the copyright notice for
the library among them as well as a reference directing the user to the copy of this license also you must do one of these things a accompany the work
with the complete corresponding machine readable source code for the library including whatever changes were used in the work which must be
distributed under sections 1 and 2 above and if the work is an executable linked with the library with the complete machine readable work that uses
the library as object code and or source code so that the user can modify the library and then relink to produce a modified executable containing the
modified library it is understood that the user who changes the contents of definitions files in the library will not necessarily be able to recompile
the application to use the modified definitions b accompany the work with a written offer valid for at least three years to give the same user the
materials specified in subsection 6a above for a charge no more than the cost of performing this distribution c if distribution of the work is made by
offering access to copy from a designated place offer equivalent access to copy the above specified materials from the same place d verify that the
user has already received a copy of these materials or that you have already sent this user a copy for an executable the required form of the work
that uses the library must include any data and utility programs needed for reproducing the executable from it however as a special exception the
source code distributed need not include anything that is normally distributed in either source or binary form with the major components compiler
kernel and so on of the operating system on which the executable runs unless that component itself accompanies the executable it may happen that this
requirement contradicts the license restrictions of other proprietary libraries that do not normally accompany the operating system such a
contradiction means you cannot use both them and the library together in an executable that you distribute 7 you may place library facilities that are
a work based on the library side by side in a single library together with other library facilities not covered by this license and distribute such a
combined library provided that the separate distribution of the work based on the library and of the other library facilities is otherwise permitted
and provided that you do these two things a accompany the combined library with a copy of the same work based on the library uncombined with any other
library facilities this must be distributed under the terms of the sections above b give prominent notice with the combined library of the fact that
part of it is a work based on the library and explaining where to find the accompanying uncombined form of the same work 8 you may not copy modify
sublicense link with or distribute the library except as expressly provided under this license any attempt otherwise to copy modify sublicense link
with or distribute the library is void and will automatically terminate your rights under this license however parties who have received copies or
rights from you under this license will not have their licenses terminated so long as such parties remain in full compliance 9 you are not required to
accept this license since you have not signed it however nothing else grants you permission to modify or distribute the library or its derivative
works these actions are prohibited by law if you do not accept this license therefore by modifying or distributing the library or any work based on
the library you indicate your acceptance of this license to do so and all its terms and conditions for copying distributing or modifying the library
or works based on it 10 each time you redistribute the library or any work based on the library the recipient automatically receives a license from
the original licensor to copy distribute link with or modify the library subject to these terms and conditions you may not impose any further
restrictions on the recipients exercise of the rights granted herein you are not responsible for enforcing compliance by third parties to this license
11 if as a consequence of a court judgment or allegation of patent infringement or for any other reason not limited to patent issues conditions are
imposed on you whether by court order agreement or otherwise that contradict the conditions of this license they do not excuse you from the conditions
of this license if you cannot distribute so as to satisfy simultaneously your obligations under this license and any other pertinent obligations then
as a consequence you may not distribute the library at all for example if a patent license would not permit royalty free redistribution of the library
by all those who receive copies directly or indirectly through you then the only way you could satisfy both it and this license would be to refrain
entirely from distribution of the library if any portion of this section is held invalid or unenforceable under any particular circumstance the
balance of the section is intended to apply and the section as a whole is intended to apply in other circumstances it is not the purpose of this
section to induce you to infringe any patents or other property right claims or to contest validity of any such claims this section has the sole
purpose of protecting the integrity of the free software distribution system which is implemented by public license practices many people have made
generous contributions to the wide range of software distributed through that system in reliance on consistent application of that system it is up to
the author donor to decide if he or she is willing to distribute software through any other system and a licensee cannot impose that choice this
section is intended to make thoroughly clear what is believed to be a consequence of the rest of this license 12 if the distribution and or use of the
library is restricted in certain countries either by patents or by copyrighted interfaces the original copyright holder who places the library under
this license may add an explicit geographical distribution limitation excluding those countries so that distribution is permitted only in or among
countries not thus excluded in such case this license incorporates the limitation as if written in the body of this license 13 the free software
foundation may publish revised and or new versions of the library general public license from time to time such new versions will be similar in spirit
to the present version but may differ in detail to address new problems or concerns each version is given a distinguishing version number if the
library specifies a version number of this license which applies to it and any later version you have the option of following the terms and conditions
either of that version or of any later version published by the free software foundation if the library does not specify a license version number you
may choose any version ever published by the free software foundation 14 if you wish to incorporate parts of the library into other free programs
whose distribution conditions are incompatible with these write to the author to ask for permission for software which is copyrighted by the free
software foundation write to the free software foundation we sometimes make exceptions for this our decision will be guided by the two goals of
preserving the free status of all derivatives of our free software and of promoting the sharing and reuse of software generally no warranty 15 because
the library is licensed free of charge there is no warranty for the library to the extent permitted by applicable law except when otherwise stated in
writing the copyright holders and or other parties provide the library as is without warranty of any kind either expressed or implied including but
not limited to the implied warranties of merchantability and fitness for a particular purpose the entire risk as to the quality and performance of the
library is with you should the library prove defective you assume the cost of all necessary servicing repair or correction 16 in no event unless
required by applicable law or agreed to in writing will any copyright holder or any other party who may modify and or redistribute the library as
permitted above be liable to you for damages including any general special incidental or consequential damages arising out of the use or inability to
use the library including but not limited to loss of data or data being rendered inaccurate or losses sustained by you or third parties or a failure
of the library to operate with any other software even if such holder or other party has been advised of the possibility of such damages end of terms
and conditions how to apply these terms to your new libraries if you develop a new library and you want it to be of the greatest possible use to the
public we recommend making it free software that everyone can redistribute and change you can do so by permitting redistribution under these terms or
alternatively under the terms of the ordinary general public license to apply these terms attach the following notices to the library it is safest to
attach them to the start of each source file to most effectively convey the exclusion of warranty and each file should have at least the copyright
line and a pointer to where the full notice is found one line to give the library s name and a brief idea of what it does copyright c year name of
author this library is free software you can redistribute it and or modify it under the terms of the gnu library general public license as published
by the free software foundation either version 2 of the license or at your option any later version this library is distributed in the hope that it
will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu library
general public license for more details you should have received a copy of the gnu library general public license along with this library if not write
to the free software foundation inc 51 franklin street fifth floor boston ma 02110 1301 usa also add information on how to contact you by electronic
and paper mail you should also get your employer if you work as a programmer or your school if any to sign a copyright disclaimer for the library if
necessary here is a sample alter the names yoyodyne inc hereby disclaims all copyright interest in the library frob a library for tweaking knobs
written by james random hacker signature of ty coon 1 april 1990 ty coon president of vice that s all there is to it""",
    "LGPL-2.1": """
gnu lesser general public license version 2 1 february 1999 copyright c 1991 1999 free software foundation inc 51 franklin street fifth floor boston
ma 02110 1301 usa everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed this is the
first released version of the lesser gpl it also counts as the successor of the gnu library public license version 2 hence the version number 2 1
preamble the licenses for most software are designed to take away your freedom to share and change it by contrast the gnu general public licenses are
intended to guarantee your freedom to share and change free software to make sure the software is free for all its users this license the lesser
general public license applies to some specially designated software packages typically libraries of the free software foundation and other authors
who decide to use it you can use it too but we suggest you first think carefully about whether this license or the ordinary general public license is
the better strategy to use in any particular case based on the explanations below when we speak of free software we are referring to freedom of use
not price our general public licenses are designed to make sure that you have the freedom to distribute copies of free software and charge for this
service if you wish that you receive source code or can get it if you want it that you can change the software and use pieces of it in new free
programs and that you are informed that you can do these things to protect your rights we need to make restrictions that forbid distributors to deny
you these rights or to ask you to surrender these rights these restrictions translate to certain responsibilities for you if you distribute copies of
the library or if you modify it for example if you distribute copies of the library whether gratis or for a fee you must give the recipients all the
rights that we gave you you must make sure that they too receive or can get the source code if you link other code with the library you must provide
complete object files to the recipients so that they can relink them with the library after making changes to the library and recompiling it and you
must show them these terms so they know their rights we protect your rights with a two step method 1 we copyright the library and 2 we offer you this
license which gives you legal permission to copy distribute and or modify the library to protect each distributor we want to make it very clear that
there is no warranty for the free library also if the library is modified by someone else and passed on the recipients should know that what they have
is not the original version so that the original author s reputation will not be affected by problems that might be introduced by others finally
software patents pose a constant threat to the existence of any free program we wish to make sure that a company cannot effectively restrict the users
of a free program by obtaining a restrictive license from a patent holder therefore we insist that any patent license obtained for a version of the
library must be consistent with the full freedom of use specified in this license most gnu software including some libraries is covered by the
ordinary gnu general public license this license the gnu lesser general public license applies to certain designated libraries and is quite different
from the ordinary general public license we use this license for certain libraries in order to permit linking those libraries into non free programs
when a program is linked with a library whether statically or using a shared library the combination of the two is legally speaking a combined work a
derivative of the original library the ordinary general public license therefore permits such linking only if the entire combination fits its criteria
of freedom the lesser general public license permits more lax criteria for linking other code with the library we call this license the lesser general
public license because it does less to protect the user s freedom than the ordinary general public license it also provides other free software
developers less of an advantage over competing non free programs these disadvantages are the reason we use the ordinary general public license for
many libraries however the lesser license provides advantages in certain special circumstances for example on rare occasions there may be a special
need to encourage the widest possible use of a certain library so that it becomes a de facto standard to achieve this non free programs must be
allowed to use the library a more frequent case is that a free library does the same job as widely used non free libraries in this case there is
little to gain by limiting the free library to free software only so we use the lesser general public license in other cases permission to use a
particular library in non free programs enables a greater number of people to use a large body of free software for example permission to use the gnu
c library in non free programs enables many more people to use the whole gnu operating system as well as its variant the gnu linux operating system
although the lesser general public license is less protective of the users freedom it does ensure that the user of a program that is linked with the
library has the freedom and the wherewithal to run that program using a modified version of the library the precise terms and conditions for copying
distribution and modification follow pay close attention to the difference between a work based on the library and a work that uses the library the
former contains code derived from the library whereas the latter must be combined with the library in order to run gnu lesser general public license
terms and conditions for copying distribution and modification 0 this license agreement applies to any software library or other program which
contains a notice placed by the copyright holder or other authorized party saying it may be distributed under the terms of this lesser general public
license also called this license each licensee is addressed as you a library means a collection of software functions and or data prepared so as to be
conveniently linked with application programs which use some of those functions and data to form executables the library below refers to any such
software library or work which has been distributed under these terms a work based on the library means either the library or any derivative work
under copyright law that is to say a work containing the library or a portion of it either verbatim or with modifications and or translated
straightforwardly into another language hereinafter translation is included without limitation in the term modification source code for a work means
the preferred form of the work for making modifications to it for a library complete source code means all the source code for all modules it contains
plus any associated interface definition files plus the scripts used to control compilation and installation of the library activities other than
copying distribution and modification are not covered by this license they are outside its scope the act of running a program using the library is not
restricted and output from such a program is covered only if its contents constitute a work based on the library independent of the use of the library
in a tool for writing it whether that is true depends on what the library does and what the program that uses the library does 1 you may copy and
distribute verbatim copies of the library s complete source code as you receive it in any medium provided that you conspicuously and appropriately
publish on each copy an appropriate copyright notice and disclaimer of warranty keep intact all the notices that refer to this license and to the
absence of any warranty and distribute a copy of this license along with the library you may charge a fee for the physical act of transferring a copy
and you may at your option offer warranty protection in exchange for a fee 2 you may modify your copy or copies of the library or any portion of it
thus forming a work based on the library and copy and distribute such modifications or work under the terms of section 1 above provided that you also
meet all of these conditions a the modified work must itself be a software library b you must cause the files modified to carry prominent notices
stating that you changed the files and the date of any change c you must cause the whole of the work to be licensed at no charge to all third parties
under the terms of this license d if a facility in the modified library refers to a function or a table of data to be supplied by an application
program that uses the facility other than as an argument passed when the facility is invoked then you must make a good faith effort to ensure that in
the event an application does not supply such function or table the facility still operates and performs whatever part of its purpose remains
meaningful for example a function in a library to compute square roots has a purpose that is entirely well defined independent of the application
therefore subsection 2d requires that any application supplied function or table used by this function must be optional if the application does not
supply it the square root function must still compute square roots these requirements apply to the modified work as a whole if identifiable sections
of that work are not derived from the library and can be reasonably considered independent and separate works in themselves then this license and its
terms do not apply to those sections when you distribute them as separate works but when you distribute the same sections as part of a whole which is
a work based on the library the distribution of the whole must be on the terms of this license whose permissions for other licensees extend to the
entire whole and thus to each and every part regardless of who wrote it thus it is not the intent of this section to claim rights or contest your
rights to work written entirely by you rather the intent is to exercise the right to control the distribution of derivative or collective works based
on the library in addition mere aggregation of another work not based on the library with the library or with a work based on the library on a volume
of a storage or distribution medium does not bring the other work under the scope of this license 3 you may opt to apply the terms of the ordinary gnu
general public license instead of this license to a given copy of the library to do this you must alter all the notices that refer to this license so
that they refer to the ordinary gnu general public license version 2 instead of to this license if a newer version than version 2 of the ordinary gnu
general public license has appeared then you can specify that version instead if you wish do not make any other change in these notices once this
change is made in a given copy it is irreversible for that copy so the ordinary gnu general public license applies to all subsequent copies and
derivative works made from that copy this option is useful when you wish to copy part of the code of the library into a program that is not a library
4 you may copy and distribute the library or a portion or derivative of it under section 2 in object code or executable form under the terms of
sections 1 and 2 above provided that you accompany it with the complete corresponding machine readable source code which must be distributed under the
terms of sections 1 and 2 above on a medium customarily used for software interchange if distribution of object code is made by offering access to
copy from a designated place then offering equivalent access to copy the source code from the same place satisfies the requirement to distribute the
source code even though third parties are not compelled to copy the source along with the object code 5 a program that contains no derivative of any
portion of the library but is designed to work with the library by being compiled or linked with it is called a work that uses the library such a work
in isolation is not a derivative work of the library and therefore falls outside the scope of this license however linking a work that uses the
library with the library creates an executable that is a derivative of the library because it contains portions of the library rather than a work that
uses the library the executable is therefore covered by this license section 6 states terms for distribution of such executables when a work that uses
the library uses material from a header file that is part of the library the object code for the work may be a derivative work of the library even
though the source code is not whether this is true is especially significant if the work can be linked without the library or if the work is itself a
library the threshold for this to be true is not precisely defined by law if such an object file uses only numerical parameters data structure layouts
and accessors and small macros and small inline functions ten lines or less in length then the use of the object file is unrestricted regardless of
whether it is legally a derivative work executables containing this object code plus portions of the library will still fall under section 6 otherwise
if the work is a derivative of the library you may distribute the object code for the work under the terms of section 6 any executables containing
that work also fall under section 6 whether or not they are linked directly with the library itself 6 as an exception to the sections above you may
also combine or link a work that uses the library with the library to produce a work containing portions of the library and distribute that work under
terms of your choice provided that the terms permit modification of the work for the customer s own use and reverse engineering for debugging such
modifications you must give prominent notice with each copy of the work that the library is used in it and that the library and its use are covered by
this license you must supply a copy of this license if the work during execution displays copyright notices you must include the copyright notice for
the library among them as well as a reference directing the user to the copy of this license also you must do one of these things a accompany the work
with the complete corresponding machine readable source code for the library including whatever changes were used in the work which must be
distributed under sections 1 and 2 above and if the work is an executable linked with the library with the complete machine readable work that uses
the library as object code and or source code so that the user can modify the library and then relink to produce a modified executable containing the
modified library it is understood that the user who changes the contents of definitions files in the library will not necessarily be able to recompile
the application to use the modified definitions b use a suitable shared library mechanism for linking with the library a suitable mechanism is one
that 1 uses at run time a copy of the library already present on the user s computer system rather than copying library functions into the executable
and 2 will operate properly with a modified version of the library if the user installs one as long as the modified version is interface compatible
with the version that the work was made with c accompany the work with a written offer valid for at least three years to give the same user the
materials specified in subsection 6a above for a charge no more than the cost of performing this distribution d if distribution of the work is made by
offering access to copy from a designated place offer equivalent access to copy the above specified materials from the same place e verify that the
user has already received a copy of these materials or that you have already sent this user a copy for an executable the required form of the work
that uses the library must include any data and utility programs needed for reproducing the executable from it however as a special exception the
materials to be distributed need not include anything that is normally distributed in either source or binary form with the major components compiler
kernel and so on of the operating system on which the executable runs unless that component itself accompanies the executable it may happen that this
requirement contradicts the license restrictions of other proprietary libraries that do not normally accompany the operating system such a
contradiction means you cannot use both them and the library together in an executable that you distribute 7 you may place library facilities that are
a work based on the library side by side in a single library together with other library facilities not covered by this license and distribute such a
combined library provided that the separate distribution of the work based on the library and of the other library facilities is otherwise permitted
and provided that you do these two things a accompany the combined library with a copy of the same work based on the library uncombined with any other
library facilities this must be distributed under the terms of the sections above b give prominent notice with the combined library of the fact that
part of it is a work based on the library and explaining where to find the accompanying uncombined form of the same work 8 you may not copy modify
sublicense link with or distribute the library except as expressly provided under this license any attempt otherwise to copy modify sublicense link
with or distribute the library is void and will automatically terminate your rights under this license however parties who have received copies or
rights from you under this license will not have their licenses terminated so long as such parties remain in full compliance 9 you are not required to
accept this license since you have not signed it however nothing else grants you permission to modify or distribute the library or its derivative
works these actions are prohibited by law if you do not accept this license therefore by modifying or distributing the library or any work based on
the library you indicate your acceptance of this license to do so and all its terms and conditions for copying distributing or modifying the library
or works based on it 10 each time you redistribute the library or any work based on the library the recipient automatically receives a license from
the original licensor to copy distribute link with or modify the library subject to these terms and conditions you may not impose any further
restrictions on the recipients exercise of the rights granted herein you are not responsible for enforcing compliance by third parties with this
license 11 if as a consequence of a court judgment or allegation of patent infringement or for any other reason not limited to patent issues
conditions are imposed on you whether by court order agreement or otherwise that contradict the conditions of this license they do not excuse you from
the conditions of this license if you cannot distribute so as to satisfy simultaneously your obligations under this license and any other pertinent
obligations then as a consequence you may not distribute the library at all for example if a patent license would not permit royalty free
redistribution of the library by all those who receive copies directly or indirectly through you then the only way you could satisfy both it and this
license would be to refrain entirely from distribution of the library if any portion of this section is held invalid or unenforceable under any
particular circumstance the balance of the section is intended to apply and the section as a whole is intended to apply in other circumstances it is
not the purpose of this section to induce you to infringe any patents or other property right claims or to contest validity of any such claims this
section has the sole purpose of protecting the integrity of the free software distribution system which is implemented by public license practices
many people have made generous contributions to the wide range of software distributed through that system in reliance on consistent application of
that system it is up to the author donor to decide if he or she is willing to distribute software through any other system and a licensee cannot
impose that choice this section is intended to make thoroughly clear what is believed to be a consequence of the rest of this license 12 if the
distribution and or use of the library is restricted in certain countries either by patents or by copyrighted interfaces the original copyright holder
who places the library under this license may add an explicit geographical distribution limitation excluding those countries so that distribution is
permitted only in or among countries not thus excluded in such case this license incorporates the limitation as if written in the body of this license
13 the free software foundation may publish revised and or new versions of the lesser general public license from time to time such new versions will
be similar in spirit to the present version but may differ in detail to address new problems or concerns each version is given a distinguishing
version number if the library specifies a version number of this license which applies to it and any later version you have the option of following
the terms and conditions either of that version or of any later version published by the free software foundation if the library does not specify a
license version number you may choose any version ever published by the free software foundation 14 if you wish to incorporate parts of the library
into other free programs whose distribution conditions are incompatible with these write to the author to ask for permission for software which is
copyrighted by the free software foundation write to the free software foundation we sometimes make exceptions for this our decision will be guided by
the two goals of preserving the free status of all derivatives of our free software and of promoting the sharing and reuse of software generally no
warranty 15 because the library is licensed free of charge there is no warranty for the library to the extent permitted by applicable law except when
otherwise stated in writing the copyright holders and or other parties provide the library as is without warranty of any kind either expressed or
implied including but not limited to the implied warranties of merchantability and fitness for a particular purpose the entire risk as to the quality
and performance of the library is with you should the library prove defective you assume the cost of all necessary servicing repair or correction 16
in no event unless required by applicable law or agreed to in writing will any copyright holder or any other party who may modify and or redistribute
the library as permitted above be liable to you for damages including any general special incidental or consequential damages arising out of the use
or inability to use the library including but not limited to loss of data or data being rendered inaccurate or losses sustained by you or third
parties or a failure of the library to operate with any other software even if such holder or other party has been advised of the possibility of such
damages end of terms and conditions how to apply these terms to your new libraries if you develop a new library and you want it to be of the greatest
possible use to the public we recommend making it free software that everyone can redistribute and change you can do so by permitting redistribution
under these terms or alternatively under the terms of the ordinary general public license to apply these terms attach the following notices to the
library it is safest to attach them to the start of each source file to most effectively convey the exclusion of warranty and each file should have at
least the copyright line and a pointer to where the full notice is found one line to give the library s name and a brief idea of what it does
copyright c year name of author this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general
public license as published by the free software foundation either version 2 1 of the license or at your option any later version this library is
distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a
particular purpose see the gnu lesser general public license for more details you should have received a copy of the gnu lesser general public license
along with this library if not write to the free software foundation inc 51 franklin street fifth floor boston ma 02110 1301 usa also add information
on how to contact you by electronic and paper mail you should also get your employer if you work as a programmer or your school if any to sign a
copyright disclaimer for the library if necessary here is a sample alter the names yoyodyne inc hereby disclaims all copyright interest in the library
frob a library for tweaking knobs written by james random hacker signature of ty coon 1 april 1990 ty coon president of vice that s all there is to it""",
    "LGPL-3.0": """
gnu lesser general public license version 3 29 june 2007 copyright c 2007 free software foundation inc https fsf org everyone is permitted to copy and
distribute verbatim copies of this license document but changing it is not allowed this version of the gnu lesser general public license incorporates
the terms and conditions of version 3 of the gnu general public license supplemented by the additional permissions listed below 0 additional
definitions as used herein this license refers to version 3 of the gnu lesser general public license and the gnu gpl refers to version 3 of the gnu
general public license the library refers to a covered work governed by this license other than an application or a combined work as defined below an
application is any work that makes use of an interface provided by the library but which is not otherwise based on the library defining a subclass of
a class defined by the library is deemed a mode of using an interface provided by the library a combined work is a work produced by combining or
linking an application with the library the particular version of the library with which the combined work was made is also called the linked version
the minimal corresponding source for a combined work means the corresponding source for the combined work excluding any source code for portions of
the combined work that considered in isolation are based on the application and not on the linked version the corresponding application code for a
combined work means the object code and or source code for the application including any data and utility programs needed for reproducing the combined
work from the application but excluding the system libraries of the combined work 1 exception to section 3 of the gnu gpl you may convey a covered
work under sections 3 and 4 of this license without being bound by section 3 of the gnu gpl 2 conveying modified versions if you modify a copy of the
library and in your modifications a facility refers to a function or data to be supplied by an application that uses the facility other than as an
argument passed when the facility is invoked then you may convey a copy of the modified version a under this license provided that you make a good
faith effort to ensure that in the event an application does not supply the function or data the facility still operates and performs whatever part of
its purpose remains meaningful or b under the gnu gpl with none of the additional permissions of this license applicable to that copy 3 object code
incorporating material from library header files the object code form of an application may incorporate material from a header file that is part of
the library you may convey such object code under terms of your choice provided that if the incorporated material is not limited to numerical
parameters data structure layouts and accessors or small macros inline functions and templates ten or fewer lines in length you do both of the
following a give prominent notice with each copy of the object code that the library is used in it and that the library and its use are covered by
this license b accompany the object code with a copy of the gnu gpl and this license document 4 combined works you may convey a combined work under
terms of your choice that taken together effectively do not restrict modification of the portions of the library contained in the combined work and
reverse engineering for debugging such modifications if you also do each of the following a give prominent notice with each copy of the combined work
that the library is used in it and that the library and its use are covered by this license b accompany the combined work with a copy of the gnu gpl
and this license document c for a combined work that displays copyright notices during execution include the copyright notice for the library among
these notices as well as a reference directing the user to the copies of the gnu gpl and this license document d do one of the following 0 convey the
minimal corresponding source under the terms of this license and the corresponding application code in a form suitable for and under terms that permit
the user to recombine or relink the application with a modified version of the linked version to produce a modified combined work in the manner
specified by section 6 of the gnu gpl for conveying corresponding source 1 use a suitable shared library mechanism for linking with the library a
suitable mechanism is one that a uses at run time a copy of the library already present on the user s computer system and b will operate properly with
a modified version of the library that is interface compatible with the linked version e provide installation information but only if you would
otherwise be required to provide such information under section 6 of the gnu gpl and only to the extent that such information is necessary to install
and execute a modified version of the combined work produced by recombining or relinking the application with a modified version of the linked version
if you use option 4d0 the installation information must accompany the minimal corresponding source and corresponding application code if you use
option 4d1 you must provide the installation information in the manner specified by section 6 of the gnu gpl for conveying corresponding source 5
combined libraries you may place library facilities that are a work based on the library side by side in a single library together with other library
facilities that are not applications and are not covered by this license and convey such a combined library under terms of your choice if you do both
of the following a accompany the combined library with a copy of the same work based on the library uncombined with any other library facilities
conveyed under the terms of this license b give prominent notice with the combined library that part of it is a work based on the library and
explaining where to find the accompanying uncombined form of the same work 6 revised versions of the gnu lesser general public license the free
software foundation may publish revised and or new versions of the gnu lesser general public license from time to time such new versions will be
similar in spirit to the present version but may differ in detail to address new problems or concerns each version is given a distinguishing version
number if the library as you received it specifies that a certain numbered version of the gnu lesser general public license or any later version
applies to it you have the option of following the terms and conditions either of that published version or of any later version published by the free
software foundation if the library as you received it does not specify a version number of the gnu lesser general public license you may choose any
version of the gnu lesser general public license ever published by the free software foundation if the library as you received it specifies that a
proxy can decide whether future versions of the gnu lesser general public license shall apply that proxy s public statement of acceptance of any
version is permanent authorization for you to choose that version for the library""",
    "MPL-1.1": """
mozilla public license version 1 1 1 definitions 1 0 1 commercial use means distribution or otherwise making the covered code available to a third
party 1 1 contributor means each entity that creates or contributes to the creation of modifications 1 2 contributor version means the combination of
the original code prior modifications used by a contributor and the modifications made by that particular contributor 1 3 covered code means the
original code or modifications or the combination of the original code and modifications in each case including portions thereof 1 4 electronic
distribution mechanism means a mechanism generally accepted in the software development community for the electronic transfer of data 1 5 executable
means covered code in any form other than source code 1 6 initial developer means the individual or entity identified as the initial developer in the
source code notice required by exhibit a 1 7 larger work means a work which combines covered code or portions thereof with code not governed by the
terms of this license 1 8 license means this document 1 8 1 licensable means having the right to grant to the maximum extent possible whether at the
time of the initial grant or subsequently acquired any and all of the rights conveyed herein 1 9 modifications means any addition to or deletion from
the substance or structure of either the original code or any previous modifications when covered code is released as a series of files a modification
is a any addition to or deletion from the contents of a file containing original code or previous modifications b any new file that contains any part
of the original code or previous modifications 1 10 original code means source code of computer software code which is described in the source code
notice required by exhibit a as original code and which at the time of its release under this license is not already covered code governed by this
license 1 10 1 patent claims means any patent claim s now owned or hereafter acquired including without limitation method process and apparatus claims
in any patent licensable by grantor 1 11 source code means the preferred form of the covered code for making modifications to it including all modules
it contains plus any associated interface definition files scripts used to control compilation and installation of an executable or source code
differential comparisons against either the original code or another well known available covered code of the contributor s choice the source code can
be in a compressed or archival form provided the appropriate decompression or de archiving software is widely available for no charge 1 12 you or your
means an individual or a legal entity exercising rights under and complying with all of the terms of this license or a future version of this license
issued under section 6 1 for legal entities you includes any entity which controls is controlled by or is under common control with you for purposes
of this definition control means a the power direct or indirect to cause the direction or management of such entity whether by contract or otherwise
or b ownership of more than fifty percent 50 of the outstanding shares or beneficial ownership of such entity 2 source code license 2 1 the initial
developer grant the initial developer hereby grants you a world wide royalty free non exclusive license subject to third party intellectual property
claims a under intellectual property rights other than patent or trademark licensable by initial developer to use reproduce modify display perform
sublicense and distribute the original code or portions thereof with or without modifications and or as part of a larger work and b under patents
claims infringed by the making using or selling of original code to make have made use practice sell and offer for sale and or otherwise dispose of
the original code or portions thereof c the licenses granted in this section 2 1 a and b are effective on the date initial developer first distributes
original code under the terms of this license d notwithstanding section 2 1 b above no patent license is granted 1 for code that you delete from the
original code 2 separate from the original code or 3 for infringements caused by i the modification of the original code or ii the combination of the
original code with other software or devices 2 2 contributor grant subject to third party intellectual property claims each contributor hereby grants
you a world wide royalty free non exclusive license a under intellectual property rights other than patent or trademark licensable by contributor to
use reproduce modify display perform sublicense and distribute the modifications created by such contributor or portions thereof either on an
unmodified basis with other modifications as covered code and or as part of a larger work and b under patent claims infringed by the making using or
selling of modifications made by that contributor either alone and or in combination with its contributor version or portions of such combination to
make use sell offer for sale have made and or otherwise dispose of 1 modifications made by that contributor or portions thereof and 2 the combination
of modifications made by that contributor with its contributor version or portions of such combination c the licenses granted in sections 2 2 a and 2
2 b are effective on the date contributor first makes commercial use of the covered code d notwithstanding section 2 2 b above no patent license is
granted 1 for any code that contributor has deleted from the contributor version 2 separate from the contributor version 3 for infringements caused by
i third party modifications of contributor version or ii the combination of modifications made by that contributor with other software except as part
of the contributor version or other devices or 4 under patent claims infringed by covered code in the absence of modifications made by that
contributor 3 distribution obligations 3 1 application of license the modifications which you create or to which you contribute are governed by the
terms of this license including without limitation section 2 2 the source code version of covered code may be distributed only under the terms of this
license or a future version of this license released under section 6 1 and you must include a copy of this license with every copy of the source code
you distribute you may not offer or impose any terms on any source code version that alters or restricts the applicable version of this license or the
recipients rights hereunder however you may include an additional document offering the additional rights described in section 3 5 3 2 availability of
source code any modification which you create or to which you contribute must be made available in source code form under the terms of this license
either on the same media as an executable version or via an accepted electronic distribution mechanism to anyone to whom you made an executable
version available and if made available via electronic distribution mechanism must remain available for at least twelve 12 months after the date it
initially became available or at least six 6 months after a subsequent version of that particular modification has been made available to such
recipients you are responsible for ensuring that the source code version remains available even if the electronic distribution mechanism is maintained
by a third party 3 3 description of modifications you must cause all covered code to which you contribute to contain a file documenting the changes
you made to create that covered code and the date of any change you must include a prominent statement that the modification is derived directly or
indirectly from original code provided by the initial developer and including the name of the initial developer in a the source code and b in any
notice in an executable version or related documentation in which you describe the origin or ownership of the covered code 3 4 intellectual property
matters a third party claims if contributor has knowledge that a license under a third party s intellectual property rights is required to exercise
the rights granted by such contributor under sections 2 1 or 2 2 contributor must include a text file with the source code distribution titled legal
which describes the claim and the party making the claim in sufficient detail that a recipient will know whom to contact if contributor obtains such
knowledge after the modification is made available as described in section 3 2 contributor shall promptly modify the legal file in all copies
contributor makes available thereafter and shall take other steps such as notifying appropriate mailing lists or newsgroups reasonably calculated to
inform those who received the covered code that new knowledge has been obtained b contributor apis if contributor s modifications include an
application programming interface and contributor has knowledge of patent licenses which are reasonably necessary to implement that api contributor
must also include this information in the legal file c representations contributor represents that except as disclosed pursuant to section 3 4 a above
contributor believes that contributor s modifications are contributor s original creation s and or contributor has sufficient rights to grant the
rights conveyed by this license 3 5 required notices you must duplicate the notice in exhibit a in each file of the source code if it is not possible
to put such notice in a particular source code file due to its structure then you must include such notice in a location such as a relevant directory
where a user would be likely to look for such a notice if you created one or more modification s you may add your name as a contributor to the notice
described in exhibit a you must also duplicate this license in any documentation for the source code where you describe recipients rights or ownership
rights relating to covered code you may choose to offer and to charge a fee for warranty support indemnity or liability obligations to one or more
recipients of covered code however you may do so only on your own behalf and not on behalf of the initial developer or any contributor you must make
it absolutely clear than any such warranty support indemnity or liability obligation is offered by you alone and you hereby agree to indemnify the
initial developer and every contributor for any liability incurred by the initial developer or such contributor as a result of warranty support
indemnity or liability terms you offer 3 6 distribution of executable versions you may distribute covered code in executable form only if the
requirements of section 3 1 3 5 have been met for that covered code and if you include a notice stating that the source code version of the covered
code is available under the terms of this license including a description of how and where you have fulfilled the obligations of section 3 2 the
notice must be conspicuously included in any notice in an executable version related documentation or collateral in which you describe recipients
rights relating to the covered code you may distribute the executable version of covered code or ownership rights under a license of your choice which
may contain terms different from this license provided that you are in compliance with the terms of this license and that the license for the
executable version does not attempt to limit or alter the recipient s rights in the source code version from the rights set forth in this license if
you distribute the executable version under a different license you must make it absolutely clear that any terms which differ from this license are
offered by you alone not by the initial developer or any contributor you hereby agree to indemnify the initial developer and every contributor for any
liability incurred by the initial developer or such contributor as a result of any such terms you offer 3 7 larger works you may create a larger work
by combining covered code with other code not governed by the terms of this license and distribute the larger work as a single product in such a case
you must make sure the requirements of this license are fulfilled for the covered code 4 inability to comply due to statute or regulation if it is
impossible for you to comply with any of the terms of this license with respect to some or all of the covered code due to statute judicial order or
regulation then you must a comply with the terms of this license to the maximum extent possible and b describe the limitations and the code they
affect such description must be included in the legal file described in section 3 4 and must be included with all distributions of the source code
except to the extent prohibited by statute or regulation such description must be sufficiently detailed for a recipient of ordinary skill to be able
to understand it 5 application of this license this license applies to code to which the initial developer has attached the notice in exhibit a and to
related covered code 6 versions of the license 6 1 new versions netscape communications corporation netscape may publish revised and or new versions
of the license from time to time each version will be given a distinguishing version number 6 2 effect of new versions once covered code has been
published under a particular version of the license you may always continue to use it under the terms of that version you may also choose to use such
covered code under the terms of any subsequent version of the license published by netscape no one other than netscape has the right to modify the
terms applicable to covered code created under this license 6 3 derivative works if you create or use a modified version of this license which you may
only do in order to apply it to code which is not already covered code governed by this license you must a rename your license so that the phrases
mozilla mozillapl mozpl netscape mpl npl or any confusingly similar phrase do not appear in your license except to note that your license differs from
this license and b otherwise make it clear that your version of the license contains terms which differ from the mozilla public license and netscape
public license filling in the name of the initial developer original code or contributor in the notice described in exhibit a shall not of themselves
be deemed to be modifications of this license 7 disclaimer of warranty covered code is provided under this license on an as is basis without warranty
of any kind either expressed or implied including without limitation warranties that the covered code is free of defects merchantable fit for a
particular purpose or non infringing the entire risk as to the quality and performance of the covered code is with you should any covered code prove
defective in any respect you not the initial developer or any other contributor assume the cost of any necessary servicing repair or correction this
disclaimer of warranty constitutes an essential part of this license no use of any covered code is authorized hereunder except under this disclaimer 8
termination 8 1 this license and the rights granted hereunder will terminate automatically if you fail to comply with terms herein and fail to cure
such breach within 30 days of becoming aware of the breach all sublicenses to the covered code which are properly granted shall survive any
termination of this license provisions which by their nature must remain in effect beyond the termination of this license shall survive 8 2 if you
initiate litigation by asserting a patent infringement claim excluding declatory judgment actions against initial developer or a contributor the
initial developer or contributor against whom you file such action is referred to as participant alleging that a such participant s contributor
version directly or indirectly infringes any patent then any and all rights granted by such participant to you under sections 2 1 and or 2 2 of this
license shall upon 60 days notice from participant terminate prospectively unless if within 60 days after receipt of notice you either i agree in
writing to pay participant a mutually agreeable reasonable royalty for your past and future use of modifications made by such participant or ii
withdraw your litigation claim with respect to the contributor version against such participant if within 60 days of notice a reasonable royalty and
payment arrangement are not mutually agreed upon in writing by the parties or the litigation claim is not withdrawn the rights granted by participant
to you under sections 2 1 and or 2 2 automatically terminate at the expiration of the 60 day notice period specified above b any software hardware or
device other than such participant s contributor version directly or indirectly infringes any patent then any rights granted to you by such
participant under sections 2 1 b and 2 2 b are revoked effective as of the date you first made used sold distributed or had made modifications made by
that participant 8 3 if you assert a patent infringement claim against participant alleging that such participant s contributor version directly or
indirectly infringes any patent where such claim is resolved such as by license or settlement prior to the initiation of patent infringement
litigation then the reasonable value of the licenses granted by such participant under sections 2 1 or 2 2 shall be taken into account in determining
the amount or value of any payment or license 8 4 in the event of termination under sections 8 1 or 8 2 above all end user license agreements
excluding distributors and resellers which have been validly granted by you or any distributor hereunder prior to termination shall survive
termination 9 limitation of liability under no circumstances and under no legal theory whether tort including negligence contract or otherwise shall
you the initial developer any other contributor or any distributor of covered code or any supplier of any of such parties be liable to any person for
any indirect special incidental or consequential damages of any character including without limitation damages for loss of goodwill work stoppage
computer failure or malfunction or any and all other commercial damages or losses even if such party shall have been informed of the possibility of
such damages this limitation of liability shall not apply to liability for death or personal injury resulting from such party s negligence to the
extent applicable law prohibits such limitation some jurisdictions do not allow the exclusion or limitation of incidental or consequential damages so
this exclusion and limitation may not apply to you 10 u s government end users the covered code is a commercial item as that term is defined in 48 c f
r 2 101 oct 1995 consisting of commercial computer software and commercial computer software documentation as such terms are used in 48 c f r 12 212
sept 1995 consistent with 48 c f r 12 212 and 48 c f r 227 7202 1 through 227 7202 4 june 1995 all u s government end users acquire covered code with
only those rights set forth herein 11 miscellaneous this license represents the complete agreement concerning subject matter hereof if any provision
of this license is held to be unenforceable such provision shall be reformed only to the extent necessary to make it enforceable this license shall be
governed by california law provisions except to the extent applicable law if any provides otherwise excluding its conflict of law provisions with
respect to disputes in which at least one party is a citizen of or an entity chartered or registered to do business in the united states of america
any litigation relating to this license shall be subject to the jurisdiction of the federal courts of the northern district of california with venue
lying in santa clara county california with the losing party responsible for costs including without limitation court costs and reasonable attorneys
fees and expenses the application of the united nations convention on contracts for the international sale of goods is expressly excluded any law or
regulation which provides that the language of a contract shall be construed against the drafter shall not apply to this license 12 responsibility for
claims as between initial developer and the contributors each party is responsible for claims and damages arising directly or indirectly out of its
utilization of rights under this license and you agree to work with initial developer and contributors to distribute such responsibility on an
equitable basis nothing herein is intended or shall be deemed to constitute any admission of liability 13 multiple licensed code initial developer may
designate portions of the covered code as multiple licensed multiple licensed means that the initial developer permits you to utilize portions of the
covered code under your choice of the mpl or the alternative licenses if any specified by the initial developer in the file described in exhibit a
exhibit a mozilla public license the contents of this file are subject to the mozilla public license version 1 1 the license you may not use this file
except in compliance with the license you may obtain a copy of the license at https www mozilla org mpl software distributed under the license is
distributed on an as is basis without warranty of any kind either express or implied see the license for the specific language governing rights and
limitations under the license the original code is the initial developer of the original code is portions created by are copyright c all rights
reserved contributor s alternatively the contents of this file may be used under the terms of the license the license in which case the provisions of
license are applicable instead of those above if you wish to allow use of your version of this file only under the terms of the license and not to
allow others to use your version of this file under the mpl indicate your decision by deleting the provisions above and replace them with the notice
and other provisions required by the license if you do not delete the provisions above a recipient may use your version of this file under either the
mpl or the license note the text of this exhibit a may differ slightly from the text of the notices in the source code files of the original code you
should use the text of this exhibit a rather than the text found in the original code source code for your modifications""",
    "MPL-2.0": """
mozilla public license version 2 0 1 definitions 1 1 contributor means each individual or legal entity that creates contributes to the creation of or
owns covered software 1 2 contributor version means the combination of the contributions of others if any used by a contributor and that particular
contributor s contribution 1 3 contribution means covered software of a particular contributor 1 4 covered software means source code form to which
the initial contributor has attached the notice in exhibit a the executable form of such source code form and modifications of such source code form
in each case including portions thereof 1 5 incompatible with secondary licenses means a that the initial contributor has attached the notice
described in exhibit b to the covered software or b that the covered software was made available under the terms of version 1 1 or earlier of the
license but not also under the terms of a secondary license 1 6 executable form means any form of the work other than source code form 1 7 larger work
means a work that combines covered software with other material in a separate file or files that is not covered software 1 8 license means this
document 1 9 licensable means having the right to grant to the maximum extent possible whether at the time of the initial grant or subsequently any
and all of the rights conveyed by this license 1 10 modifications means any of the following a any file in source code form that results from an
addition to deletion from or modification of the contents of covered software or b any new file in source code form that contains any covered software
1 11 patent claims of a contributor means any patent claim s including without limitation method process and apparatus claims in any patent licensable
by such contributor that would be infringed but for the grant of the license by the making using selling offering for sale having made import or
transfer of either its contributions or its contributor version 1 12 secondary license means either the gnu general public license version 2 0 the gnu
lesser general public license version 2 1 the gnu affero general public license version 3 0 or any later versions of those licenses 1 13 source code
form means the form of the work preferred for making modifications 1 14 you or your means an individual or a legal entity exercising rights under this
license for legal entities you includes any entity that controls is controlled by or is under common control with you for purposes of this definition
control means a the power direct or indirect to cause the direction or management of such entity whether by contract or otherwise or b ownership of
more than fifty percent 50 of the outstanding shares or beneficial ownership of such entity 2 license grants and conditions 2 1 grants each
contributor hereby grants you a world wide royalty free non exclusive license a under intellectual property rights other than patent or trademark
licensable by such contributor to use reproduce make available modify display perform distribute and otherwise exploit its contributions either on an
unmodified basis with modifications or as part of a larger work and b under patent claims of such contributor to make use sell offer for sale have
made import and otherwise transfer either its contributions or its contributor version 2 2 effective date the licenses granted in section 2 1 with
respect to any contribution become effective for each contribution on the date the contributor first distributes such contribution 2 3 limitations on
grant scope the licenses granted in this section 2 are the only rights granted under this license no additional rights or licenses will be implied
from the distribution or licensing of covered software under this license notwithstanding section 2 1 b above no patent license is granted by a
contributor a for any code that a contributor has removed from covered software or b for infringements caused by i your and any other third party s
modifications of covered software or ii the combination of its contributions with other software except as part of its contributor version or c under
patent claims infringed by covered software in the absence of its contributions this license does not grant any rights in the trademarks service marks
or logos of any contributor except as may be necessary to comply with the notice requirements in section 3 4 2 4 subsequent licenses no contributor
makes additional grants as a result of your choice to distribute the covered software under a subsequent version of this license see section 10 2 or
under the terms of a secondary license if permitted under the terms of section 3 3 2 5 representation each contributor represents that the contributor
believes its contributions are its original creation s or it has sufficient rights to grant the rights to its contributions conveyed by this license 2
6 fair use this license is not intended to limit any rights you have under applicable copyright doctrines of fair use fair dealing or other
equivalents 2 7 conditions sections 3 1 3 2 3 3 and 3 4 are conditions of the licenses granted in section 2 1 3 responsibilities 3 1 distribution of
source form all distribution of covered software in source code form including any modifications that you create or to which you contribute must be
under the terms of this license you must inform recipients that the source code form of the covered software is governed by the terms of this license
and how they can obtain a copy of this license you may not attempt to alter or restrict the recipients rights in the source code form 3 2 distribution
of executable form if you distribute covered software in executable form then a such covered software must also be made available in source code form
as described in section 3 1 and you must inform recipients of the executable form how they can obtain a copy of such source code form by reasonable
means in a timely manner at a charge no more than the cost of distribution to the recipient and b you may distribute such executable form under the
terms of this license or sublicense it under different terms provided that the license for the executable form does not attempt to limit or alter the
recipients rights in the source code form under this license 3 3 distribution of a larger work you may create and distribute a larger work under terms
of your choice provided that you also comply with the requirements of this license for the covered software if the larger work is a combination of
covered software with a work governed by one or more secondary licenses and the covered software is not incompatible with secondary licenses this
license permits you to additionally distribute such covered software under the terms of such secondary license s so that the recipient of the larger
work may at their option further distribute the covered software under the terms of either this license or such secondary license s 3 4 notices you
may not remove or alter the substance of any license notices including copyright notices patent notices disclaimers of warranty or limitations of
liability contained within the source code form of the covered software except that you may alter any license notices to the extent required to remedy
known factual inaccuracies 3 5 application of additional terms you may choose to offer and to charge a fee for warranty support indemnity or liability
obligations to one or more recipients of covered software however you may do so only on your own behalf and not on behalf of any contributor you must
make it absolutely clear that any such warranty support indemnity or liability obligation is offered by you alone and you hereby agree to indemnify
every contributor for any liability incurred by such contributor as a result of warranty support indemnity or liability terms you offer you may
include additional disclaimers of warranty and limitations of liability specific to any jurisdiction 4 inability to comply due to statute or
regulation if it is impossible for you to comply with any of the terms of this license with respect to some or all of the covered software due to
statute judicial order or regulation then you must a comply with the terms of this license to the maximum extent possible and b describe the
limitations and the code they affect such description must be placed in a text file included with all distributions of the covered software under this
license except to the extent prohibited by statute or regulation such description must be sufficiently detailed for a recipient of ordinary skill to
be able to understand it 5 termination 5 1 the rights granted under this license will terminate automatically if you fail to comply with any of its
terms however if you become compliant then the rights granted under this license from a particular contributor are reinstated a provisionally unless
and until such contributor explicitly and finally terminates your grants and b on an ongoing basis if such contributor fails to notify you of the non
compliance by some reasonable means prior to 60 days after you have come back into compliance moreover your grants from a particular contributor are
reinstated on an ongoing basis if such contributor notifies you of the non compliance by some reasonable means this is the first time you have
received notice of non compliance with this license from such contributor and you become compliant prior to 30 days after your receipt of the notice 5
2 if you initiate litigation against any entity by asserting a patent infringement claim excluding declaratory judgment actions counter claims and
cross claims alleging that a contributor version directly or indirectly infringes any patent then the rights granted to you by any and all
contributors for the covered software under section 2 1 of this license shall terminate 5 3 in the event of termination under sections 5 1 or 5 2
above all end user license agreements excluding distributors and resellers which have been validly granted by you or your distributors under this
license prior to termination shall survive termination 6 disclaimer of warranty covered software is provided under this license on an as is basis
without warranty of any kind either expressed implied or statutory including without limitation warranties that the covered software is free of
defects merchantable fit for a particular purpose or non infringing the entire risk as to the quality and performance of the covered software is with
you should any covered software prove defective in any respect you not any contributor assume the cost of any necessary servicing repair or correction
this disclaimer of warranty constitutes an essential part of this license no use of any covered software is authorized under this license except under
this disclaimer 7 limitation of liability under no circumstances and under no legal theory whether tort including negligence contract or otherwise
shall any contributor or anyone who distributes covered software as permitted above be liable to you for any direct indirect special incidental or
consequential damages of any character including without limitation damages for lost profits loss of goodwill work stoppage computer failure or
malfunction or any and all other commercial damages or losses even if such party shall have been informed of the possibility of such damages this
limitation of liability shall not apply to liability for death or personal injury resulting from such party s negligence to the extent applicable law
prohibits such limitation some jurisdictions do not allow the exclusion or limitation of incidental or consequential damages so this exclusion and
limitation may not apply to you 8 litigation any litigation relating to this license may be brought only in the courts of a jurisdiction where the
defendant maintains its principal place of business and such litigation shall be governed by laws of that jurisdiction without reference to its
conflict of law provisions nothing in this section shall prevent a party s ability to bring cross claims or counter claims 9 miscellaneous this
license represents the complete agreement concerning the subject matter hereof if any provision of this license is held to be unenforceable such
provision shall be reformed only to the extent necessary to make it enforceable any law or regulation which provides that the language of a contract
shall be construed against the drafter shall not be used to construe this license against a contributor 10 versions of the license 10 1 new versions
mozilla foundation is the license steward except as provided in section 10 3 no one other than the license steward has the right to modify or publish
new versions of this license each version will be given a distinguishing version number 10 2 effect of new versions you may distribute the covered
software under the terms of the version of the license under which you originally received the covered software or under the terms of any subsequent
version published by the license steward 10 3 modified versions if you create software not governed by this license and you want to create a new
license for such software you may create and use a modified version of this license if you rename the license and remove any references to the name of
the license steward except to note that such modified license differs from this license 10 4 distributing source code form that is incompatible with
secondary licenses if you choose to distribute source code form that is incompatible with secondary licenses under the terms of this version of the
license the notice described in exhibit b of this license must be attached exhibit a source code form license notice this source code form is subject
to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2
0 if it is not possible or desirable to put the notice in a particular file then you may include the notice in a location such as a license file in a
relevant directory where a recipient would be likely to look for such a notice you may add additional accurate notices of copyright ownership exhibit
b incompatible with secondary licenses notice this source code form is incompatible with secondary licenses as defined by the mozilla public license v
2 0""",
}
